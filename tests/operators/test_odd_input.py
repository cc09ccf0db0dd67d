"""Headers, character sets, persons, look-ups, merges and outliers on odd input, against plain Python."""

import random
import re
from statistics import median

import pytest

from hustings.operators import extraction, joins, resolve, trends
from hustings.sources import readers
from hustings.streaming import twins
from hustings.workers import scratch


def header(lines, parties, words=(), below=7, data=r"^\s*[0-9(]", body=None):
    ranked = sorted(parties, key=lambda p: -len(p))
    for i in range(len(lines)):
        near = " ".join(lines[i : i + 3])
        if body and re.search(body, near):
            return []
        hits = [p for p in ranked if p in near]
        found = [p for p in hits if not any(p != q and p in q for q in hits)]
        if len(found) >= 2:
            names = []
            for x in lines[i + 1 : i + 1 + below]:
                if re.search(data, x):
                    break
                names += [t for t in re.findall(r"[^\W\d_]{2,4}", x) if t not in words and not any(p.startswith(t) or p.endswith(t) for p in parties)]
            return list(zip(found, names))
    return []


def test_paired_header(spark):
    parties = ["Union", "Labour", "Uni", "New.Left", "Left"]
    pages = {
        "two lines": ["Union Labour", "Kim Lee", "12 88"],
        "scattered": ["poll", "Labour", "of Union", "weights", "Kim", "Lee Park", "3 4"],
        "fewer names": ["Labour New.Left Union", "Lee", "Uni on our", "1 2"],
        "more names": ["Labour Union", "Kim Lee Park Choi"],
        "data first": ["12 Union Labour", "Kim Lee"],
        "late": ["x"] * 9 + ["Union Labour", "a", "Kim cases", "Lee"],
        "one party": ["Union", "Kim"],
        "none": [""],
    }
    rng = random.Random(3)
    for k in range(40):
        pages[f"r{k}"] = [" ".join(rng.choices(["Union", "Labour", "Uni", "Left", "New.Left", "NewxLeft", "Kim", "Lee", "Park", "12", "cases", "on"], k=rng.randrange(4))) for _ in range(rng.randrange(1, 12))]
    rows = [(p, i, t or None) for p, lines in pages.items() for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "p string, i int, t string").repartition(3)
    for body in (r"3 4|^12", None):
        got = {}
        for r in extraction.paired_header(df, ["p"], "i", "t", parties, words=["cases"], body=body).orderBy("p", "pos").collect():
            got.setdefault(r.p, []).append((r.party, r.name))
        assert got == {p: h for p, lines in pages.items() if (h := header(lines, parties, ["cases"], body=body))}
    assert got["two lines"] == [("Labour", "Kim"), ("Union", "Lee")]


def test_character_sets_by_file(spark, tmp_path):
    rows = {"ascii.csv": ("utf-8", "plain"), "late.csv": ("latin-1", "x" * 9000 + "é"), "last.csv": ("latin-1", "né"), "utf8.csv": ("utf-8", "né, 김"), "korean.csv": ("cp949", "김부겸"), "wide.csv": ("utf-16", "김 é")}
    for k, (name, (kind, text)) in enumerate(rows.items()):
        (tmp_path / name).write_bytes(f'k,name\n{k},"{text}"\n'.encode(kind))
    got = {r.k: r.name for r in readers.encoded_csv(spark, str(tmp_path), "k long, name string").collect()}
    assert got == {k: text for k, (_, text) in enumerate(rows.values())}
    kinds = {r.file.rsplit("/", 1)[1]: r.encoding for r in readers.encodings(spark, str(tmp_path)).collect()}
    assert kinds == {"ascii.csv": "UTF-8", "late.csv": "ISO-8859-1", "last.csv": "ISO-8859-1", "utf8.csv": "UTF-8", "korean.csv": "cp949", "wide.csv": "UTF-16"}


def persons(rows):
    group = {r[0]: r[0] for r in rows}
    for i, n, b, s, a, y in rows:
        for j, m, c, t, d, z in rows:
            if i < j and n is not None and n == m and not (b is not None and c is not None and b != c) and not (s is not None and t is not None and s != t):
                if (b is not None and b == c) or (s is not None and s == t) or (a is not None and a == d and y is not None and z is not None and abs(y - z) <= 16):
                    x, w = sorted((group[i], group[j]))
                    group = {k: x if v == w else v for k, v in group.items()}
    out = {}
    births = {g: {r[2] for r in rows if group[r[0]] == g and r[2] is not None} for g in group.values()}
    for r in rows:
        g = group[r[0]]
        key = (g, r[2] if len(births[g]) > 1 else None)
        out.setdefault(key, []).append(r[0])
    return {i: min(ids) for ids in out.values() for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_persons(spark, seed):
    rng = random.Random(seed)
    some = lambda *x: rng.choice([None, None, *x])
    rows = [(i, rng.choice(["n", "m", None]), some(1, 2, 3), some("s", "t"), some("a", "b"), some(1960, 1970, 1990, 2020)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, b long, s string, a string, y int").repartition(4)
    assert {r.id: r.person for r in resolve.person_clusters(df, "name", "id", "b", "s", "a", "y").collect()} == persons(rows)


def test_look_ups_of_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k long, v string")
    right = spark.createDataFrame([(1, False), (1, True), (2, False), (2, None), (None, True)], "k long, there boolean")
    assert {r.v: r.status for r in joins.roster_status(left, right, ["k"], "there").collect()} == {"x": "registered", "y": "absent", "z": "unknown", "n": "unknown"}
    got = {r.v: (r.there, r.is_pending) for r in joins.pending(left, right, "k").collect()}
    assert got == {"x": (False, False), "y": (None, False), "z": (None, True), "n": (None, True)}


def test_merged_twice_with_null_keys(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (None, "b"), (None, "b"), (1, "a"), (2, None)], "k long, g string").write.parquet(f"{tmp_path}/in")
    path = scratch(spark, "merged")
    for _ in range(2):
        twins.merged(twins.source(spark, f"{tmp_path}/in", "*.parquet", "k long, g string"), path, ["k", "g"], "odd")
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(path).collect()))) == ["(1, 'a')", "(2, None)", "(None, 'b')"]


def test_outliers(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", None]), rng.choice([None, *range(60)]), rng.choice([None, float(rng.randrange(400)) / 4])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, d int, v double").selectExpr("id", "g", "date_add(date '2024-01-01', d) as day", "v").repartition(4)
    want = {}
    for i, g, d, v in rows:
        near = [w for _, h, e, w in rows if h == g and d is not None and e is not None and abs(d - e) <= 9 and w is not None]
        if d is not None and v is not None and len(near) >= 3:
            m = median(near)
            mad = median(abs(w - m) for w in near)
            if mad >= 2 and abs(v - m) > max(5, 1.5 * mad):
                want[i] = (len(near), m, mad)
    got = {r.id: (r.n, r["median"], r.mad) for r in trends.mad_outliers(df, ["g"], "day", "v", "id", 9, floor=5.0, times=1.5).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want) and want

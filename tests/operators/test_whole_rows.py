"""Repeated rows, nulls in each column and clashing groups: a row in is a row out."""

import datetime as dt
import json
import random
import statistics
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from hustings.operators import geometry, joins, layout, resolve, trends
from hustings.sources import readers
from hustings.sources.paged import PagedReader
from hustings.streaming import twins
from hustings import workers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_name_by_upper_bound(spark):
    df = spark.createDataFrame([("F", "1996-01"), ("F", "1996-01"), ("F", "2001-01"), ("F", None), (None, "1996-01"), ("G", "1996-01")], "party string, ym string")
    eras = spark.createDataFrame([("F", "1997-01", "one"), ("F", None, "now"), ("O", "1990-01", "x")], "party string, upper string, name string")
    got = rows(joins.name_by_upper_bound(df, eras, "party", "ym", "upper", "name"))
    assert got == sorted([("F", "1996-01", "one"), ("F", "1996-01", "one"), ("F", "2001-01", "now"), ("F", None, "now"), (None, "1996-01", None), ("G", "1996-01", "G")], key=repr)


def test_anchored(spark):
    words = spark.createDataFrame([(1, 10.0, None), (1, 10.0, None), (1, None, "a"), (None, 10.0, "b"), (2, 10.0, "c")], "page int, x double, t string")
    anchors = spark.createDataFrame([(1, 8.0), (1, 12.0), (1, 12.0), (1, 50.0), (None, 10.0)], "page int, at double")
    got = rows(layout.anchored(words, anchors, ["page"], "x", "at", 5))
    assert got == sorted([(1, 10.0, None, 8.0), (1, 10.0, None, 8.0), (1, None, "a", None), (None, 10.0, "b", None), (2, 10.0, "c", None)], key=repr)


def test_longest_contained(spark):
    df = spark.createDataFrame([("z", "north hill", None), ("z", "north hill", None), ("z", None, 1), (None, "north", 2), ("y", "north", 3)], "zone string, t string, n int")
    bases = spark.createDataFrame([("z", "north"), ("z", "hill"), ("z", "nort"), ("z", None), ("z", "north")], "zone string, base string")
    got = rows(joins.longest_contained(df, "t", bases, "base", ["zone"]))
    assert got == sorted([("z", "north hill", None, "north")] * 2 + [("z", None, 1, None), (None, "north", 2, None), ("y", "north", 3, None)], key=repr)


def test_first_key_that_matches(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1), ("c", 2)], "k string, n int")
    table = spark.createDataFrame([("A", 7), ("A", 5), ("a!", 9)], "w string, v int")
    got = rows(joins.first_key_that_matches(df, F.array(F.upper("k"), F.concat("k", F.lit("!"))), table, "w", "v"))
    assert got == sorted([("a", None, 5, 0)] * 2 + [(None, 1, None, None), ("c", 2, None, None)], key=repr)


def test_nearest_month(spark):
    d = lambda y, m: dt.date(y, m, 1)
    df = spark.createDataFrame([(1, d(2000, 5), None), (1, d(2000, 5), None), (1, None, "a"), (None, d(2000, 5), "b"), (2, d(2000, 5), "c")], "k int, m date, t string")
    c = spark.createDataFrame([(1, d(2000, 1), 4), (1, d(1999, 12), 3), (1, d(2000, 1), 2), (1, None, 1)], "k int, m2 date, v int")
    got = rows(trends.nearest_month(df, c, ["k"], "m", "m2", "v", ["v"]))
    assert got == sorted([(1, d(2000, 5), None, 2)] * 2 + [(1, None, "a", None), (None, d(2000, 5), "b", None), (2, d(2000, 5), "c", None)], key=repr)


def test_located(spark):
    points = spark.createDataFrame([(1.0, 1.0, None), (1.0, 1.0, None), (None, 1.0, "a"), (9.0, 9.0, "b")], "x double, y double, t string")
    zones = spark.createDataFrame([(k, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]) for k in (5, 4)], "zone int, ring array<struct<x:double,y:double>>")
    got = rows(geometry.located(points, zones, "x", "y", "zone", "ring", 2.0))
    assert got == sorted([(1.0, 1.0, None, 4)] * 2 + [(None, 1.0, "a", None), (9.0, 9.0, "b", None)], key=repr)


def test_grid_components(spark):
    cells = [("A", 0, 0), ("B", 0, 0), ("A", 1, 0), ("A", 1, 0), ("B", 5, 5), (None, 0, 0), (None, 0, 1), ("A", None, 1), ("A", 0, 3_000_000), ("A", 3, 0)]
    got = rows(layout.grid_components(spark.createDataFrame(cells, "g string, c int, r int"), "g"))
    assert got == sorted([("A", 0, 0, 0), ("B", 0, 0, 0), ("A", 1, 0, 0), ("A", 1, 0, 0), ("B", 5, 5, 5_000_005), (None, 0, 0, 0), (None, 0, 1, 0), ("A", None, 1, None), ("A", 0, 3_000_000, 3_000_000), ("A", 3, 0, 3_000_000)], key=repr)
    long = spark.range(700).selectExpr("'g' as g", "cast(id as int) as c", "0 as r")
    assert layout.grid_components(long, "g").filter("component = 0").count() == 700


def brute_persons(people, most_years=16):
    label = {p[0]: p[0] for p in people}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, n, b, s, a, y in people:
        for j, m, c, t, e, z in people:
            if i < j and n is not None and n == m and not (b and c and b != c) and not (s and t and s != t):
                if (b and b == c) or (s and s == t) or (a is not None and a == e and y is not None and z is not None and abs(y - z) <= most_years):
                    p, q = sorted((root(i), root(j)))
                    label[q] = p
    births = {}
    for i, _, b, *_ in people:
        births.setdefault(root(i), set()).update([b] if b else [])
    part = {i: (root(i), (b or "?") if len(births[root(i)]) > 1 else "") for i, _, b, *_ in people}
    return {i: min(j for j in part if part[j] == part[i]) for i in part}


@pytest.mark.parametrize("seed", range(4))
def test_person_clusters(spark, seed):
    import random

    pick = random.Random(seed).choice
    people = [(i, pick(["kim", "lee", None]), pick([None, None, "b1", "b2", "b3"]), pick([None, None, "s1", "s2"]), pick(["x", "y", "z", None]), pick([1950, 1960, 1967, 1984, 2001, 2018, None])) for i in range(60)]
    df = spark.createDataFrame(people, "id long, name string, b string, s string, a string, y int")
    got = {r.id: r.person for r in resolve.person_clusters(df, "name", "id", "b", "s", "a", "y").collect()}
    want = brute_persons(people)
    assert {k: v for k, v in got.items()} == want


def test_totals_or_parts_keeps_null_units(spark):
    df = spark.createDataFrame([(None, "a", 1), ("u", "a", 2), (None, "b", 4)], "unit string, c string, v int")
    assert rows(readers.totals_or_parts(df, "unit", ["sum"], ["c"], "v")) == [("a", 3), ("b", 4)]
    with_total = df.union(spark.createDataFrame([("sum", "a", 9)], df.schema))
    assert rows(readers.totals_or_parts(with_total, "unit", ["sum"], ["c"], "v")) == [("a", 9)]


def test_paged_source_tells_absence_from_failure():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response({"/a/1": 200, "/gone/1": 404}.get(self.path, 500))
            self.end_headers()
            if self.path == "/a/1":
                self.wfile.write(json.dumps({"total": 1, "rows": [{"x": 1}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = PagedReader({"template": f"http://127.0.0.1:{server.server_port}/{{key}}/{{page}}", "keys": "a,gone,broken"})
    a, gone, broken = reader.partitions()
    assert list(reader.read(a)) == [("a", 1, '{"x": 1}')] and list(reader.read(gone)) == []
    with pytest.raises(Exception, match="500"):
        list(reader.read(broken))
    server.shutdown()
    with pytest.raises(Exception):
        list(PagedReader({"template": "http://127.0.0.1:9/{key}/{page}", "keys": "a"}).read(a))


def test_completeness_in_the_shared_folder(spark, tmp_path):
    data = spark.createDataFrame([("a", 99.0), ("a", 100.0), ("b", 50.0), ("c", None)], "unit string, pct double")
    for k in range(3):
        data.filter(f"pct is null or pct % 3 = {k}").write.parquet(str(tmp_path / f"{k}"))
    stream = spark.readStream.schema(data.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = rows(twins.completeness(stream, ["unit"], "pct", "counting"))
    assert [(r[0], r[1], r[3]) for r in got] == [("a", 99.0, True), ("b", 50.0, False), ("c", None, False)]


def test_temporary_tables_are_deleted(spark):
    import os

    with workers.temporary(spark) as keep:
        gone = workers.written(spark.range(3), "gone")
        with workers.temporary(spark) as inner:
            kept = inner(workers.written(gone, "kept"))
        keep(kept)
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_the_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workers.shared_dir(Session)
    Session.conf.get = staticmethod(lambda key, default: "hdfs:///shared")
    assert workers.shared_dir(Session) == "hdfs:///shared"


def test_paged_source_stops_at_known_pages(tmp_path):
    (tmp_path / "k").mkdir()
    for page in range(1, 6):
        (tmp_path / "k" / str(page)).write_text(json.dumps({"total": 10, "rows": [{"id": 20 - 2 * page}, {"id": 19 - 2 * page}]}))
    options = {"template": f"file://{tmp_path}/{{key}}/{{page}}", "keys": "k,none"}
    read = lambda **more: [p for _, p, _ in PagedReader(options | more).read(PagedReader(options).partitions()[0])]
    assert read() == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert read(known="16,15,14,13,12,11", stop="2") == [1, 1, 2, 2, 3, 3] and read(known="16,14", stop="1") == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert list(PagedReader(options).read(PagedReader(options).partitions()[1])) == []


def test_outliers_as_python_finds_them(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 1.0, 5.5, 20.0, 30.0, 31.0, 90.0]), "x") for i in range(400)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "i long, k string, d int, v double, extra string").withColumn("day", F.date_add(F.lit("2024-01-01"), F.col("d")))
    want = []
    for i, k, d, v, _ in rows:
        near = [y for _, k2, d2, y, _ in rows if k2 == k and None not in (d, d2, y) and abs(d - d2) <= 3]
        if v is None or len(near) < 3:
            continue
        m = statistics.median(near)
        mad = statistics.median(abs(y - m) for y in near)
        if mad >= 2 and abs(v - m) > max(15, 1.5 * mad):
            want.append((i, len(near), m, mad))
    got = trends.mad_outliers(df, ["k"], "day", "v", "i", days=3, times=1.5).select("i", "n", "median", "mad").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
    assert trends.mad_outliers(df.limit(0), ["k"], "day", "v", "i").count() == 0


def test_aliases_keep_every_row(spark):
    rows = [("a", 1), ("a", 1), ("a", 9), ("b", 9), (None, 3), ("a", None), ("z", 3)]
    df = spark.createDataFrame(rows, "n string, t int")
    life = spark.createDataFrame([("a", 2, None, "b", None), ("b", None, 5, None, "c")], "name string, since int, until int, before_as string, after_as string")
    got = sorted(map(tuple, joins.resolve_aliases(df, life, "n", "t", rounds=3).collect()), key=str)
    assert got == sorted([("a", 1, "b"), ("a", 1, "b"), ("a", 9, "a"), ("b", 9, "c"), (None, 3, None), ("a", None, "a"), ("z", 3, "z")], key=str)

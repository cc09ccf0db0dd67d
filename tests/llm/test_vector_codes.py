"""Vector codes against plain Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from hustings.llm import vector_codes as v


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label) -> sorted (vec_id, code, error, label_error), digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = defaultdict(int)
    for _, x, _ in kept:
        sizes[len(x)] += len(x) > 0 and len(x) % parts == 0
    sizes = {k: n for k, n in sizes.items() if n}
    d = min(sizes, key=lambda k: (-sizes[k], k)) if sizes else -1
    same = [(i, [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in xs], g) for i, xs, g in kept if len(xs) == d]
    w = max(d, 0) // parts
    same.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in same[:entries]] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c, strict=True)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, x, _ in same:
            for p in range(parts):
                held[p, near(x, p)[1]].append(cut(x, p))
        for (p, k), xs in held.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    fits = lambda n: n if n is not None and abs(n) < 2**63 else None
    out = [(i, "".join(f"{near(x, p)[1]:02x}" for p in range(parts)), fits(sum(near(x, p)[0] for p in range(parts))), g) for i, x, g in same]
    out += [(i, None, None, g) for i, x, g in kept if len(x) != d]
    by = defaultdict(list)
    for *_, e, g in out:
        by[g].append(e)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    key = lambda r: (r[0] is None, *map(str, r))
    return sorted([(i, c, e, None if None in by[g] else fits(sum(by[g])), digest) for i, c, e, g in out], key=key)


def run(spark, rows, element="float", **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{element}>, label int, code string").repartition(3)
    got = v.annotate(df, **kw)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, *map(str, r)))


def vectors(n, d, seed, scale=1.0):
    rng = random.Random(seed)
    f = lambda: round(rng.gauss(0, scale) * 1024) / 1024  # noqa: E731  exact in both float types
    return [(i, [f() for _ in range(d)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("element, scale", [("float", 1.0), ("double", 1.0), ("double", 1e15), ("float", 1e30)])
def test_equal_to_brute_force(spark, element, scale):
    rows = vectors(120, 16, 3)
    if scale > 1:
        rows = [(i, [float(x * 2.0 ** round(math.log2(scale))) for x in xs], g) for i, xs, g in rows]
    assert run(spark, rows, element) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(40, 8, 5) + vectors(6, 16, 6) + vectors(2, 9, 7)
    rows += rows[:9] + [(None, rows[0][1], 3), (None, [0.5] * 8, 3), (7, [0.25] * 8, None)]
    dropped = [(90, None, 1), (91, [None] * 8, 1), (92, [float("nan")] + [0.0] * 7, 1), (93, [float("inf")] * 8, None)]
    want = brute(rows + dropped)
    assert run(spark, rows + dropped) == want and len(want) == len(rows)
    assert run(spark, rows, rounds=2, entries=5) == brute(rows, rounds=2, entries=5)


def test_few_and_none(spark):
    assert run(spark, []) == [] == run(spark, [(1, None, 1)])
    few = vectors(3, 8, 1) + vectors(1, 8, 1)
    assert run(spark, few) == brute(few)
    odd = vectors(3, 9, 1) + [(8, [], 1)]
    assert [r[1:4] for r in run(spark, odd)] == [(None, None, None)] * 4


def test_decode(spark):
    rows = vectors(50, 16, 9)
    codes = v.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    by_id = {i: [math.floor(x * 4096) for x in xs] for i, xs, _ in rows}
    for r in codes.rows.collect():
        assert sum((a - b) ** 2 for a, b in zip(by_id[r.id], codes.decode(r.code), strict=True)) == r.error

"""Turns against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from hustings.operators import ranges, turns


def distance(a, b):
    cube = lambda c, r: (c - (r - r % 2) // 2, r)
    (q1, r1), (q2, r2) = cube(*a), cube(*b)
    return (abs(q1 - q2) + abs(r1 - r2) + abs(q1 + r1 - q2 - r2)) // 2


def in_order(starts):
    """Cells by serving one after the other."""
    taken, out = set(), []
    for c0, r0 in starts:
        reach = 0
        while True:
            near = [(distance((c, r), (c0, r0)), r, c) for r in range(r0 - reach, r0 + reach + 1) for c in range(c0 - reach - 1, c0 + reach + 2)]
            free = [x for x in near if x[0] <= reach and (x[2], x[1]) not in taken]
            if free:
                _, r, c = min(free)
                taken.add((c, r))
                out.append((c, r))
                break
            reach += 1
    return out


def test_ring_cells(spark):
    for c0, r0 in ((0, 0), (3, 5), (-2, -7)):
        df = spark.range(200).select(F.lit(c0).alias("c0"), F.lit(r0).alias("r0"), "id")
        got = [(x.c, x.r) for x in turns.ring_cells(df, "c0", "r0", "id").orderBy("id").collect()]
        want = sorted(((distance((c, r), (c0, r0)), r, c) for r in range(r0 - 9, r0 + 10) for c in range(c0 - 10, c0 + 11)))[:200]
        assert got == [(c, r) for _, r, c in want]


@pytest.mark.parametrize("seed, width, crowd", [(1, 6, 0.0), (2, 3, 0.5), (3, 1, 0.0)])
def test_placed(spark, seed, width, crowd):
    rng = random.Random(seed)
    starts = [(0, 0) if rng.random() < crowd else (rng.randrange(width), rng.randrange(2 * width)) for _ in range(90)]
    order = list(range(90))
    rng.shuffle(order)
    units = spark.createDataFrame([(o, c, r) for o, (c, r) in zip(order, starts, strict=True)] + [(99, None, 1)], "o long, c0 long, r0 long").repartition(5)
    got = {x.o: (x.c, x.r) for x in turns.placed(units, [F.col("o")]).collect()}
    by_order = sorted(zip(order, starts, strict=True))
    assert got == {o: cell for (o, _), cell in zip(by_order, in_order([s for _, s in by_order]), strict=True)} | {99: (None, None)}
    assert turns.placed(units.limit(0), [F.col("o")]).count() == 0


def test_grid_start(spark):
    rows = [(i, random.Random(i).random() * 9, random.Random(-i).random() * 5) for i in range(50)]
    df = spark.createDataFrame(rows, "o long, x double, y double")
    got = {r.o: (r.c0, r.r0) for r in turns.grid_start(df, "x", "y").collect()}
    xs, ys = [r[1] for r in rows], [r[2] for r in rows]
    columns = max(1, round((1.3 * 50 / 2.3) ** 0.5))
    high = max(1, round(2.3 * columns))
    for o, x, y in rows:
        r0 = round((max(ys) - y) / (max(ys) - min(ys) + 1e-9) * (high - 1))
        assert got[o] == (round((x - min(xs)) / (max(xs) - min(xs) + 1e-9) * (columns - 1) - (0.5 if r0 % 2 else 0.0)), r0)
    assert turns.grid_start(df.limit(0), "x", "y").count() == 0


def test_in_turn(spark):
    rng = random.Random(8)
    wishes = []
    for g in ("p", "q"):
        for rank in range(25):
            for place, item in enumerate(rng.sample(range(20), rng.randrange(0, 12))):
                wishes.append((g, f"a{rank}", rank, item, place))
    wishes.append(("p", "a0", 0, None, -1))
    taken, want = set(), set()
    for g, agent, rank, item, place in sorted(wishes, key=lambda w: (w[0], w[2], w[4])):
        if item is not None and (g, item) not in taken and not any((g, agent) == w[:2] for w in want):
            taken.add((g, item))
            want.add((g, agent, item))
    df = spark.createDataFrame(wishes, "g string, agent string, rank long, item long, place long").repartition(4)
    assert {tuple(r) for r in turns.in_turn(df, ["g"], "agent", "rank", "item", "place").collect()} == want
    assert turns.in_turn(df.limit(0), ["g"], "agent", "rank", "item", "place").count() == 0


def test_numbered_and_running_max(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(6)
    out = ranges.running_max(ranges.numbered(df, [F.col("g"), F.col("k")], "at"), ["g"], "at", "v", "most", block=16).collect()
    assert [(r.g, r.k) for r in sorted(out, key=lambda r: r.at)] == sorted(x[:2] for x in rows) and sorted(r["at"] for r in out) == list(range(300))
    for r in out:
        assert r.most == max(v for g, k, v in rows if g == r.g and k <= r.k)

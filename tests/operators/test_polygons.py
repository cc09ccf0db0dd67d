"""Polygons against plain Python on small grids and lines."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from hustings.operators import polygons


def square(c, r, size=1):
    return [(float(c), float(r)), (float(c + size), float(r)), (float(c + size), float(r + size)), (float(c), float(r + size))]


def table(spark, rows, key="string"):
    return spark.createDataFrame([(k, None if ring is None else [{"x": x, "y": y} for x, y in ring]) for k, ring in rows], f"k {key}, ring array<struct<x: double, y: double>>").repartition(3)


def grid(seed, n=7, kinds="ab."):
    rng = random.Random(seed)
    return {(c, r): k for c in range(n) for r in range(n) if (k := rng.choice(kinds)) != "."}


def test_dissolved(spark):
    cells = grid(1)
    got = polygons.dissolved(polygons.edges(table(spark, [*((k, square(*p)) for p, k in cells.items()), ("a", []), ("b", None)]), "k", "ring"), "k").collect()
    area = lambda ring: sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1])) / 2
    for k in "ab":
        own = {p for p, x in cells.items() if x == k}
        rings = [r for r in got if r.k == k]
        assert sum(r.area for r in rings) == len(own) and all(abs(area(r.ring) - r.area) < 1e-9 for r in rings)
        steps = [(p, q) for r in rings for p, q in zip(r.ring, r.ring[1:] + r.ring[:1])]
        assert all(abs(p.x - q.x) + abs(p.y - q.y) == 1 for p, q in steps)
        assert len(steps) == sum((c + dc, r + dr) not in own for c, r in own for dc, dr in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        seen, parts = set(), 0
        for p in own:
            parts += p not in seen
            stack = [p]
            while stack:
                c, r = stack.pop()
                if (c, r) in own and (c, r) not in seen:
                    seen.add((c, r))
                    stack += [(c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)]
        assert sum(r.area > 0 for r in rings) == parts
    one = polygons.dissolved(polygons.edges(table(spark, [("x", square(0, 0, 3))]), "k", "ring"), "k").collect()
    assert len(one) == 1 and one[0].area == 9


def test_noded_edges_meet(spark):
    rows = [("a", square(0, 0, 4)), ("b", square(4, 0)), ("b", square(4, 1)), ("c", square(4, 2, 2))]
    e = polygons.noded(polygons.edges(table(spark, rows), "k", "ring"), 2.0)
    assert {(r.a, r.b): r.length for r in polygons.shared_borders(e, "k").collect()} == {("a", "b"): 2.0, ("a", "c"): 2.0, ("b", "c"): 1.0}
    coast = {r.k: (r.border, r.coast) for r in polygons.coast_ratio(e, "k").collect()}
    assert coast == {"a": (16.0, 12.0), "b": (6.0, 3.0), "c": (8.0, 5.0)}


def peucker(points, tolerance):
    (x0, y0), (x1, y1) = points[0][1:], points[-1][1:]
    chord = math.hypot(x1 - x0, y1 - y0)
    far = [(abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / chord if chord else math.hypot(x - x0, y - y0), -i) for i, (_, x, y) in enumerate(points[1:-1], 1)]
    if not far or max(far)[0] <= tolerance:
        return {points[0][0], points[-1][0]}
    cut = -max(far)[1]
    return peucker(points[: cut + 1], tolerance) | peucker(points[cut:], tolerance)


def test_simplified(spark):
    rng = random.Random(2)
    lines = {name: [(i, float(i), float(rng.randrange(12))) for i in range(n)] for name, n in (("a", 40), ("b", 2), ("c", 1), (None, 9))}
    lines["ring"] = [(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 5.0, 5.0), (3, 0.0, 0.0)]
    df = spark.createDataFrame([(k, *p) for k, ps in lines.items() for p in ps] + [("a", 99, None, 1.0)], "line string, i int, px double, py double").repartition(3)
    got = defaultdict(set)
    for r in polygons.simplified(df, ["line"], "i", "px", "py", 2.5).collect():
        got[r.line].add(r.i)
    assert got == {k: peucker(ps, 2.5) for k, ps in lines.items()}


def test_contacts(spark):
    rng = random.Random(4)
    rows = [(i, square(rng.randrange(20), rng.randrange(20), rng.choice([1, 2, 5, 9]))) for i in range(25)] + [(90, None)]
    triangle = [(30.0, 30.0), (40.0, 30.0), (30.0, 40.0)]
    rows += [(50, triangle), (51, square(36, 36)), (52, square(34, 34)), (53, square(31, 31))]  # beside, touching and within the triangle
    want = {(50, 52), (50, 53)}
    for i, a in rows[:25]:
        for j, b in rows[:25]:
            if i < j and a[0][0] <= b[2][0] and b[0][0] <= a[2][0] and a[0][1] <= b[2][1] and b[0][1] <= a[2][1]:
                want.add((i, j))
    for cell in (1.0, 7.0):
        assert sorted((r.a, r.b) for r in polygons.contacts(table(spark, rows, "long"), "k", "ring", cell).collect()) == sorted(want)


def test_nearest_seeds(spark):
    rng = random.Random(6)
    cells = [(rng.randrange(-20, 30), rng.randrange(15)) for _ in range(150)] + [(0, 0), (0, 0), (None, 2)]
    seeds = [(rng.randrange(-25, 40), rng.randrange(-3, 20), s) for s in range(12)] + [(5, 5, 70), (5, 5, 71)]
    df, sd = spark.createDataFrame(cells, "x long, y long").repartition(3), spark.createDataFrame(seeds, "x long, y long, seed long")
    got = sorted(map(tuple, polygons.nearest_seeds(df, sd, "x", "y", "seed").fillna(-99).collect()))
    near = lambda x, y: min(((a - x) ** 2 + (b - y) ** 2, s) for a, b, s in seeds)[1]
    assert got == sorted((-99, 2, -99) if x is None else (x, y, near(x, y)) for x, y in cells)
    assert polygons.nearest_seeds(df, sd.limit(0), "x", "y", "seed").filter("seed IS NOT NULL").count() == 0


def merged(parts, borders):
    """Groups without an owner pick in rounds, in plain Python."""
    group = {p: p for p in parts}
    owner = {p: o for p, (o, loose) in parts.items() if not loose}
    while True:
        wishes = {}
        for g in set(group.values()):
            if g in owner:
                continue
            reach = defaultdict(int)
            for (a, b), n in borders.items():
                for p, q in ((a, b), (b, a)):
                    if group[p] == g != group[q]:
                        reach[group[q]] += n
            if reach:
                wishes[g] = max(reach, key=lambda h: (reach[h], -h))
        if not wishes:
            return {p: owner.get(g) for p, g in group.items()}
        label = {g: g for g in group.values()}
        for g, h in wishes.items():
            a, b = sorted((label[g], label[h]))
            label = {k: a if v == b else v for k, v in label.items()}
        owner = {label[g]: o for g, o in owner.items()}
        group = {p: label[g] for p, g in group.items()}


def test_absorbed_and_enclosed(spark):
    rng = random.Random(9)
    parts = {i: (rng.choice("xyz"), rng.random() < 0.6) for i in range(60)}
    borders = {}
    for _ in range(110):
        a, b = sorted(rng.sample(range(58), 2))  # two parts touch nothing
        borders[a, b] = rng.randrange(1, 5)
    df = spark.createDataFrame([(i, o, loose) for i, (o, loose) in parts.items()], "p long, o string, loose boolean").repartition(4)
    b = spark.createDataFrame([(x, y, float(n)) for (x, y), n in borders.items()], "a long, b long, length double").repartition(4)
    want = merged(parts, borders)
    assert {r.p: r.o for r in polygons.absorbed(df, b, "p", "o", "loose").collect()} == want
    for i, (_, loose) in parts.items():
        assert not loose or i >= 58 or want[i] is not None

    coast = spark.createDataFrame([(0,), (1,)], "p long")
    bare = {i for i, (_, loose) in parts.items() if loose}
    out = {i for i in (0, 1) if i in bare}
    while more := {y for pair in borders for x, y in (pair, pair[::-1]) if x in out and y in bare} - out:
        out |= more
    got = polygons.enclosed(df.withColumn("covered", ~F.col("loose")), b, coast, "p", "covered").collect()
    assert {r.p: r.is_enclosed for r in got} == {i: i not in out for i in bare}


def test_contacts_of_a_crowd_are_the_same_in_blocks(spark, monkeypatch):
    """All polygons in few cells, some within others, one with a hole and one of two parts; cells were one task's each."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rng = random.Random(3)
    spots = [(k, rng.randrange(40), rng.randrange(40), rng.randrange(1, 12), rng.randrange(1, 12)) for k in range(60)]
    rows = [(k, [(float(a), float(b)) for a, b in box(*r)]) for k, *r in spots]
    rows += [(100, [(float(a), float(b)) for a, b in box(100, 100, 30, 30)]), (100, [(float(a), float(b)) for a, b in reversed(box(105, 105, 20, 20))])]
    rows += [(101, [(float(a), float(b)) for a, b in box(110, 110, 2, 2)]), (102, [(float(a), float(b)) for a, b in box(101, 101, 2, 2)])]
    want = {(p[0], q[0]) for p in spots for q in spots if p[0] < q[0] and p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4]} | {(100, 102)}
    df = spark.createDataFrame(rows, "k long, ring array<struct<x: double, y: double>>")
    assert {tuple(r) for r in polygons.contacts(df, "k", "ring", 16.0).collect()} == want
    monkeypatch.setattr(polygons, "PAIRS", 500)
    every, own, parts = polygons._in_blocks(*[df.selectExpr(f"k AS {c}", "0 AS cx", "0 AS cy") for c in ("a", "b")], "b")
    assert parts > 4 and every.select("block").distinct().count() == 9 and every.join(own, ["cx", "cy", "block"]).count() == 64 * 64
    assert {tuple(r) for r in polygons.contacts(df, "k", "ring", 16.0).collect()} == want

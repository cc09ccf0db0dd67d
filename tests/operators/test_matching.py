"""Pairs of cells against all ways to pair them."""

import random
from functools import lru_cache

import pytest

from hustings.operators import matching


def most(near):
    @lru_cache(None)
    def best(free):
        if not free:
            return 0
        v = min(free)
        rest = free - {v}
        return max([best(rest), *(1 + best(rest - {u}) for u in near[v] if u in rest)])

    return best(frozenset(range(len(near))))


@pytest.mark.parametrize("seed", range(60))
def test_largest(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 14)
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(0, 3 * n))} if n > 1 else set()
    near = [sorted({a + b - v for a, b in edges if v in (a, b)}) for v in range(n)]
    mate = matching.matched(near)
    assert all(m < 0 or (mate[m] == v and m in near[v]) for v, m in enumerate(mate))
    assert sum(m >= 0 for m in mate) == 2 * most([tuple(x) for x in near])


def beside(c, r):
    left, right = (c - 1, c) if r % 2 == 0 else (c, c + 1)
    return {(c - 1, r), (c + 1, r), (left, r - 1), (right, r - 1), (left, r + 1), (right, r + 1)}


def test_cells(spark):
    rng = random.Random(5)
    cells = {(c, r): rng.choice("ab") for c in range(5) for r in range(5) if rng.random() < 0.8}
    rows = [(g, c, r) for (c, r), g in cells.items()]
    got = matching.paired(spark.createDataFrame([*rows, rows[0], ("a", None, 1)], "g string, c long, r long").repartition(3), "g").collect()
    assert sorted((x.g, x.c, x.r) for x in got) == sorted(rows)
    mate = {(x.c, x.r): (x.c2, x.r2) for x in got if x.c2 is not None}
    assert all(mate[q] == p and q in beside(*p) and cells[p] == cells[q] for p, q in mate.items())
    order = list(cells)
    near = [tuple(order.index(q) for q in beside(*p) if cells.get(q) == cells[p]) for p in order]
    assert len(mate) == 2 * most(near)
    with pytest.raises(ValueError):
        matching.paired(spark.createDataFrame(rows, "g string, c long, r long"), "g", most=1)
    assert matching.paired(spark.createDataFrame([], "g string, c long, r long"), "g").count() == 0

"""Assignments against the least of all, by dynamic programming over sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.operators import assignment
from hustings.plans import polygon_queries


def least(matrix):
    best = {0: 0}
    for row in matrix:
        new = {}
        for mask, total in best.items():
            for j, c in enumerate(row):
                if not mask >> j & 1:
                    new[mask | 1 << j] = min(total + c, new.get(mask | 1 << j, 10**18))
        best = new
    return best[(1 << len(matrix)) - 1] if matrix else 0


def test_totals(spark):
    rng = random.Random(4)
    groups = {g: [[rng.choice([rng.randrange(9), rng.randrange(-5, 60)]) for _ in range(n)] for _ in range(n)] for g, n in enumerate((1, 2, 5, 8))}
    groups[9] = [[7] * 4 for _ in range(4)]
    rows = [(g, 10 * i, 3 * j, c) for g, m in groups.items() for i, row in enumerate(m) for j, c in enumerate(row)]
    chosen, report = assignment.assigned(spark.createDataFrame(rows, "g long, a long, b long, cost long").repartition(4), ["g"], "a", "b", "cost")
    cost = {(g, a, b): c for g, a, b, c in rows}
    got = [tuple(r) for r in chosen.collect()]
    for r in report.collect():
        own = [x for x in got if x[0] == r.g]
        assert len({a for _, a, _ in own}) == len({b for _, _, b in own}) == len(own) == len(groups[r.g])
        assert sum(cost[x] for x in own) == r.total == least(groups[r.g]) and -1e-9 <= r.gap < 1
    assert report.count() == len(groups)


def test_what_is_not_square(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 6)], "g long, a long, b long, cost long")
    with pytest.raises(ValueError):
        assignment.assigned(df, ["g"], "a", "b", "cost")
    chosen, report = assignment.assigned(df.limit(0), ["g"], "a", "b", "cost")
    assert chosen.count() == report.count() == 0


def test_auction_and_paths_agree(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(g, i, j, rng.randrange(-9, 40)) for g, n in ((1, 2), (2, 6), (3, 9)) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "g long, a long, b long, cost long")
    totals = lambda: {r.g: (r.total, r.gap < 1) for r in assignment.assigned(df, ["g"], "a", "b", "cost")[1].collect()}
    by_paths = totals()
    monkeypatch.setattr(assignment, "MOST_IN_TASK", 5)  # the two larger groups take the auction
    assert totals() == by_paths and len(by_paths) == 3


def test_large_groups_are_settled_without_rounds(spark, monkeypatch):
    """Places on a line: matching both in order costs least. The auction took a hundred jobs or more for this."""
    monkeypatch.setattr(assignment, "MOST_ROUNDS", 0)
    n = 120
    df = spark.range(n * n).selectExpr("1 AS g", f"id div {n} AS a", f"id % {n} AS b").selectExpr("*", "abs(a * 37 % 101 - b * 59 % 97) AS cost")
    chosen, report = assignment.assigned(df, ["g"], "a", "b", "cost")
    best = sum(abs(x - y) for x, y in zip(sorted(i * 37 % 101 for i in range(n)), sorted(i * 59 % 97 for i in range(n)), strict=True))
    r = report.first()
    assert (r.total, r.gap) == (best, 0) and chosen.select("a").distinct().count() == chosen.select("b").distinct().count() == n


def test_a_pair_twice_is_not_square(spark):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 6), (1, 1, 2, 6), (1, 2, 1, 5)], "g long, a long, b long, cost long")
    with pytest.raises(ValueError):
        assignment.assigned(df, ["g"], "a", "b", "cost")


def by_kind(spark, groups):
    """Groups of (x of agents, y of items); the pairs chosen, as (group, x, y, agent, item), and (total, gap) by group."""
    agents = spark.createDataFrame([(g, 10 * i, x) for g, (xs, _) in groups.items() for i, x in enumerate(xs)], "g long, a long, x long").repartition(4)
    items = spark.createDataFrame([(g, 3 * j, y) for g, (_, ys) in groups.items() for j, y in enumerate(ys)], "g long, b long, y long").repartition(3)
    cost = F.pmod(F.col("x") * 7 + F.col("y") * 5, F.lit(11)) - 3
    chosen, report = assignment.assigned_by_kind(agents, items, ["g"], "a", "b", cost)
    pairs = [(r.g, groups[r.g][0][r.a // 10], groups[r.g][1][r.b // 3], r.a, r.b) for r in chosen.collect()]
    return pairs, {r.g: (r.total, r.gap) for r in report.collect()}


def test_kinds_give_what_all_pairs_give(spark, monkeypatch):
    rng = random.Random(11)
    groups = {g: ([rng.randrange(k) for _ in range(n)], [rng.randrange(k) for _ in range(n)]) for g, (n, k) in enumerate([(1, 1), (7, 2), (9, 4), (9, 40), (8, 1)])}
    of = lambda x, y: (x * 7 + y * 5) % 11 - 3
    few = {1: groups[1], 3: tuple(x[:4] for x in groups[3])}
    for some, most, block in ((groups, 4000, 2), (few, 3, 4096)):  # the group of more than 3 kinds goes through the auction
        monkeypatch.setattr(assignment, "MOST_IN_TASK", most)
        monkeypatch.setattr(assignment, "BLOCK", block)
        pairs, totals = by_kind(spark, some)
        for g, (xs, ys) in some.items():
            own = [p for p in pairs if p[0] == g]
            assert len({p[3] for p in own}) == len({p[4] for p in own}) == len(own) == len(xs)
            total, gap = totals[g]
            assert sum(of(x, y) for _, x, y, _, _ in own) == total == least([[of(x, y) for y in ys] for x in xs]) and -1e-9 <= gap < 1
        assert len(totals) == len(some)


def test_flows_and_paths_agree():
    rng = np.random.default_rng(2)
    for _ in range(60):
        m, k = rng.integers(1, 7, 2)
        supply = rng.integers(1, 6, m)
        supply[0] += max(0, k - supply.sum())
        demand = 1 + rng.multinomial(supply.sum() - k, [1 / k] * k)
        costs = rng.integers(-5, rng.choice([2, 50]), (m, k))
        sent, u, v = assignment.flows(costs, supply, demand)
        got = np.array([[x.get(i, 0) for x in sent] for i in range(m)])
        assert (got.sum(axis=1) == supply).all() and (got.sum(axis=0) == demand).all() and (got >= 0).all()
        every = np.repeat(np.repeat(costs, supply, 0), demand, 1)
        assert (got * costs).sum() == every[np.arange(len(every)), assignment.paths(every)[0]].sum() == (supply * u).sum() + (demand * v).sum()


def test_kinds_that_dont_fit_together(spark):
    agents = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (None, 3, 5)], "g long, a long, x long")
    items = agents.select("g", F.col("a").alias("b"), F.col("x").alias("y"))
    run = lambda a, b, c=F.col("x") - F.col("y"): assignment.assigned_by_kind(a, b, ["g"], "a", "b", c)
    assert run(agents, items)[0].count() == 2  # rows without a group have no part
    assert run(agents.limit(0), items.limit(0))[1].count() == 0
    other = spark.createDataFrame([(2, 1, 5)], "g long, a long, x long")
    for a, b in ((agents, items.filter("b = 1")), (agents.union(agents), items.union(items)), (agents.union(other), items)):
        with pytest.raises(ValueError):
            run(a, b)
    with pytest.raises(ValueError):
        run(agents.withColumn("x", F.when(F.col("a") == 1, 5)), items)


def test_the_query_makes_no_table_of_pairs(spark, monkeypatch, tmp_path):
    """A nation of more suppliers than a task assigns: the query went through the auction, over a table of the square of them."""
    monkeypatch.setattr(assignment, "MOST_IN_TASK", 110)
    monkeypatch.setattr(assignment, "MOST_ROUNDS", 0)
    n = 900
    spark.range(n).selectExpr("id AS s_suppkey", "CAST(id % 2 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.s_nationkey: (r.agents, r.places, r.total, r.proven) for r in polygon_queries.optimal_assignment(spark, str(tmp_path)).collect()}
    for g in (0, 1):
        keys = range(g, n, 2)
        total = sum(abs(x - y) for x, y in zip(sorted(k * 37 % 101 for k in keys), sorted(k * 59 % 97 for k in keys), strict=True))
        assert got[g] == (n // 2, n // 2, total, True)

"""Connected components by alternating large and small stars on edge tables; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.workers import written

MOST_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours are joined to its smallest neighbour (or itself)."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are joined to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes on edges (a, b: long); component is the smallest node reachable. Loops and repeats don't matter."""
    now = written(_small_star(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct()), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    was = state(now)
    if was[0]:
        for _ in range(MOST_ROUNDS):
            now = written(_small_star(_large_star(now)), "edges")
            if (got := state(now)) == was:
                break
            was = got
        else:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())

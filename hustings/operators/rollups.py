"""Shares, turnout and hierarchical roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in per cent; 0 where the whole is 0."""
    return F.round(F.when(whole > 0, part / whole * 100).otherwise(0.0), digits)


def share(df: DataFrame, by: list[str], votes: str, out: str = "share") -> DataFrame:
    """Adds each row's part of its group's votes in per cent, not rounded; null where the group has none."""
    total = F.sum(votes).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(total != 0, F.col(votes) / total * 100))


def roll_up(df: DataFrame, levels: list[list[str]], key: list[str], votes: str) -> DataFrame:
    """Votes by key at several levels in one plan; columns that a level leaves out are null, level is its place in `levels`."""
    every = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in [*level, *key]] for level in levels]
    columns = [F.col(c) for c in [*every, *key]]
    out = df.groupingSets(sets, *columns).agg(F.sum(votes).alias("votes"), F.grouping_id().alias("__set"))
    width = len(columns)
    number = {sum(1 << (width - 1 - i) for i, c in enumerate([*every, *key]) if c not in [*level, *key]): n for n, level in enumerate(levels)}
    level = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    return out.withColumn("level", F.element_at(level, F.col("__set").cast("int"))).drop("__set")


def recomputed_share(df: DataFrame, by: list[str], key: list[str], votes: str, digits: int) -> DataFrame:
    """Votes summed by (by, key) and their share of the sum over by: sums of parts, not means of shares."""
    summed = df.groupBy(*by, *key).agg(F.sum(votes).alias("votes"))
    return share(summed, by, "votes").withColumn("share", F.round("share", digits))


def first_level_with_data(df: DataFrame, by: list[str], level: str, order: list[str], part: str, whole: str) -> DataFrame:
    """Turnout of each group from the first level, in the given order, that has a positive whole."""
    per = df.groupBy(*by, level).agg(F.sum(part).alias("__p"), F.sum(whole).alias("__w")).filter("__w > 0")
    place = F.coalesce(*[F.when(F.col(level) == name, F.lit(i)) for i, name in enumerate(order)])
    best = per.withColumn("__at", place).filter("__at IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct(level, "__p", "__w"), "__at").alias("b"))
    return best.select(*by, F.col(f"b.{level}").alias("used_level"), ratio(F.col("b.__p"), F.col("b.__w")).alias("turnout"))


def other_bucket(df: DataFrame, by: list[str], share_col: str, least: float) -> DataFrame:
    """Each group's shares of `least` or more, and what is left, at least 0, as others."""
    shown = F.sum(F.when(F.col(share_col) >= least, F.col(share_col)).otherwise(0.0))
    return df.groupBy(*by).agg(F.count_if(F.col(share_col) >= least).alias("n_shown"), F.greatest(F.lit(0.0), 100 - shown).alias("others"))


def distinct_children(df: DataFrame, by: list[str], child: str) -> DataFrame:
    """Sorted distinct children of each group, and their number."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(child)).alias("children")).withColumn("n_children", F.size("children"))


def coverage(df: DataFrame, row: str, column: str, values: list, what: str, order: list[str]) -> DataFrame:
    """row x column -> the first of `order` that occurs; absent combinations are null."""
    place = F.coalesce(*[F.when(F.col(what) == name, F.lit(i)) for i, name in enumerate(order)], F.lit(len(order)))
    return df.withColumn("__at", place).groupBy(row).pivot(column, values).agg(F.min_by(what, "__at"))

"""Ranking within contests. Ties are always settled by the columns of `pos`, ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(votes: str, pos: list[str]) -> list[Column]:
    return [F.col(votes).desc_nulls_last(), *[F.col(p).asc_nulls_last() for p in pos]]


def rank_options(df: DataFrame, by: list[str], votes: str, pos: list[str]) -> DataFrame:
    """Adds rank (1..n by votes) and won (rank 1)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(votes, pos)))
    return df.withColumn("rank", rank).withColumn("won", F.col("rank") == 1)


def best_per_group(df: DataFrame, by: list[str], votes: str, pos: list[str], take: list[str]) -> DataFrame:
    """One row a group: `take` of the row with most votes, first by numeric `pos`. Aggregates map-side, so large groups don't meet in a sort."""
    key = F.struct(F.col(votes), *[-F.col(p) for p in pos])
    return df.groupBy(*by).agg(F.max_by(F.struct(*take), key).alias("best")).select(*by, "best.*")


def top_k(df: DataFrame, by: list[str], votes: str, pos: list[str], k: int | Column) -> DataFrame:
    """The k best of each group; k may be a column, equal within a group."""
    return rank_options(df, by, votes, pos).filter(F.col("rank") <= k).drop("won")


def margins(df: DataFrame, by: list[str], share: str, pos: list[str]) -> DataFrame:
    """One row a group: share of the first and of the second (null if there is one option only), and their difference."""
    ranked = rank_options(df, by, share, pos).filter("rank <= 2")
    two = ranked.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.col(share))).alias("first_share"), F.max(F.when(F.col("rank") == 2, F.col(share))).alias("second_share"))
    return two.withColumn("margin", F.col("first_share") - F.col("second_share"))


def closest(df: DataFrame, margin: str, most: float, n: int, pos: list[str]) -> DataFrame:
    """The n rows of least margin below `most`."""
    return df.filter(F.col(margin) < most).orderBy(F.col(margin).asc(), *pos).limit(n)


def latest(df: DataFrame, by: list[str], when: str, pos: list[str]) -> DataFrame:
    """The last row of each group by time; of several, the first by pos."""
    return rank_options(df, by, when, pos).filter("won").drop("rank", "won")


def ordinal_suffix(n: Column) -> Column:
    """st, nd, rd, th; 11 to 13 take th."""
    tens, ones = n % 100, n % 10
    return F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")

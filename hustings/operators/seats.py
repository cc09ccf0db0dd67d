"""Winners, seat totals and apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.ranking import rank_options


def winners(df: DataFrame, contest: list[str], won: str, votes: str, pos: list[str]) -> DataFrame:
    """Rows flagged as won; of a contest without any flag, exactly the first by votes."""
    marked = df.withColumnRenamed(won, "__won")
    ranked = rank_options(marked, contest, votes, pos).withColumn("__any", F.max(F.coalesce("__won", F.lit(False))).over(Window.partitionBy(*contest)))
    return ranked.filter(F.when(F.col("__any"), F.coalesce("__won", F.lit(False))).otherwise(F.col("rank") == 1)).drop("__any", "__won", "won", "rank")


def winner_counts(df: DataFrame, contest: list[str], won: str, votes: str, pos: list[str], party: str, none: str = "independent") -> DataFrame:
    """Winners by party; a missing or empty party counts as `none`."""
    return winners(df, contest, won, votes, pos).groupBy(F.coalesce(F.nullif(F.col(party), F.lit("")), F.lit(none)).alias(party)).agg(F.count("*").alias("n_won"))


def summary_or_winners(df: DataFrame, scope: str, summary: str, seats: str, by: list[str], one_each: str) -> DataFrame:
    """Per group: seats of its summary rows if it has any, else its number of rows flagged one_each."""
    is_summary = F.col(scope) == summary
    return df.groupBy(*by).agg(
        F.when(F.max(is_summary), F.sum(F.when(is_summary, F.col(seats)).otherwise(0))).otherwise(F.count_if(~is_summary & F.col(one_each))).cast("long").alias("seats"),
        F.max(is_summary).alias("from_summary"),
    )


def merged_totals(parts: list[DataFrame], party: str, seats: str, mains: DataFrame) -> DataFrame:
    """Seats of several sources by main party; mains (party, main) names the main party of each satellite."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    mapped = every.join(mains.withColumnRenamed("party", party), party, "left").select(F.coalesce("main", party).alias(party), seats)
    return mapped.groupBy(party).agg(F.sum(seats).alias("seats"))


def plurality(df: DataFrame, area: str, party: str, seats: str) -> DataFrame:
    """The party with most seats in each area and its share of the area's seats; ties go to the name that sorts first."""
    summed = df.groupBy(area, party).agg(F.sum(seats).alias("seats"))
    ranked = summed.withColumn("total", F.sum("seats").over(Window.partitionBy(area)))
    return rank_options(ranked, [area], "seats", [party]).filter("won").select(area, party, "seats", F.round(F.col("seats") / F.col("total") * 100, 2).alias("seat_share"))


def residual_seats(total, district):
    """Seats that are left for the list; never below 0."""
    return F.greatest(F.lit(0), total - district)


def largest_remainder(df: DataFrame, area: list[str], votes: str, seats: str, pos: list[str], threshold: float = 0.0, cap: tuple[int, int] | None = None) -> DataFrame:
    """Adds n_seats by Hare quota and largest remainder.

    Parties under `threshold` of all votes get 0, and the quota divides by the votes of the others. cap (numerator, denominator):
    with floor(seats * cap) at least 1, no party keeps more; what is over goes, one seat each, to qualified parties below the cap
    by remainder, and what none of them takes is lost. Integer arithmetic: votes * seats = quotient * sum + remainder.
    """
    whole = Window.partitionBy(*area)
    w = df.withColumn("__all", F.sum(votes).over(whole)).withColumn("__in", F.col(votes) >= F.col("__all") * threshold)
    w = w.withColumn("__sum", F.sum(F.when(F.col("__in"), F.col(votes)).otherwise(0)).over(whole))
    fine = F.col("__in") & (F.col("__sum") > 0)
    w = w.withColumn("__q", F.when(fine, F.floor(F.col(votes) * F.col(seats) / F.col("__sum"))).otherwise(0)).withColumn("__r", F.when(fine, F.col(votes) * F.col(seats) - F.col("__q") * F.col("__sum")).otherwise(F.lit(-1)))
    w = w.withColumn("__left", F.when(F.col("__sum") > 0, F.col(seats) - F.sum("__q").over(whole)).otherwise(0))
    by_rest = Window.partitionBy(*area).orderBy(F.col("__r").desc(), *[F.col(p) for p in pos])
    w = w.withColumn("__rank", F.row_number().over(by_rest)).withColumn("n_seats", F.col("__q") + F.when(fine & (F.col("__rank") <= F.col("__left")), 1).otherwise(0))
    if cap is not None:
        w = w.withColumn("__cap", F.floor(F.col(seats) * cap[0] / cap[1]))
        over = F.when(F.col("__cap") >= 1, F.greatest(F.lit(0), F.col("n_seats") - F.col("__cap"))).otherwise(0)
        w = w.withColumn("__over", over).withColumn("__excess", F.sum("__over").over(whole))
        takes = F.col("__in") & (F.col("__over") == 0) & (F.col("n_seats") < F.col("__cap")) & (F.col("__cap") >= 1)
        w = w.withColumn("__takes", takes)
        place = F.sum(F.col("__takes").cast("int")).over(by_rest.rowsBetween(Window.unboundedPreceding, 0))
        w = w.withColumn("__place", place).withColumn("n_seats", F.col("n_seats") - F.col("__over") + F.when(F.col("__takes") & (F.col("__place") <= F.col("__excess")), 1).otherwise(0))
    return w.select(*df.columns, F.col("n_seats").cast("long").alias("n_seats"))


def magnitudes(contests: DataFrame, area: list[str], seats: str, candidates: str, pos: list[str]) -> DataFrame:
    """Splits an area's seats over its contests evenly; the remainder goes to those with most candidates."""
    whole = Window.partitionBy(*area)
    rank = F.row_number().over(whole.orderBy(F.col(candidates).desc(), *pos))
    n = F.count("*").over(whole)
    return contests.withColumn("magnitude", (F.floor(F.col(seats) / n) + F.when(rank <= F.col(seats) % n, 1).otherwise(0)).cast("long"))


def uncontested(df: DataFrame, contest: list[str], votes: str) -> DataFrame:
    """Adds is_uncontested: the contest's only option, without votes."""
    return df.withColumn("is_uncontested", (F.count("*").over(Window.partitionBy(*contest)) == 1) & (F.coalesce(F.col(votes), F.lit(0)) == 0))


def single_approval(df: DataFrame, contest: list[str], votes: str, voted: str) -> DataFrame:
    """Adds approval: of a contest's only option, votes in per cent of those who voted; null otherwise."""
    alone = F.count("*").over(Window.partitionBy(*contest)) == 1
    return df.withColumn("approval", F.when(alone & (F.col(voted) > 0), F.round(F.col(votes) / F.col(voted) * 100, 2)))

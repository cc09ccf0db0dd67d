"""Days of elections and phases around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEDNESDAY = 2


def first_weekday(day: Column, weekday: int = WEDNESDAY) -> Column:
    """The first such weekday (Monday 0) on or after the day."""
    return F.date_add(day, F.pmod(F.lit(weekday) - F.weekday(day), F.lit(7)))


def predicted(terms: DataFrame, end: str, lead_days: Column, cycle_years: Column, horizon: Column) -> DataFrame:
    """A row for each coming election: the first Wednesday on or after the term's end less lead_days, then every cycle until the horizon."""
    first = F.date_sub(F.col(end), lead_days)
    every = F.sequence(F.lit(0), F.greatest(F.lit(0), F.year(horizon) - F.year(first)))
    days = F.filter(F.transform(every, lambda y: F.when(y % cycle_years == 0, first_weekday(F.add_months(first, 12 * y)))), lambda d: d.isNotNull() & (d <= horizon))
    return terms.select(*terms.columns, F.posexplode(days).alias("nth", "election_day"))


def phase(day: Column, election: Column, campaign_days: int = 14, blackout_days: int = 6, post_days: int = 30, recent_days: int = 365) -> Column:
    """PRE, CAMPAIGN, BLACKOUT, ELECTION, POST, RECENT or ARCHIVED by the days to the election."""
    left = F.datediff(election, day)
    return (
        F.when(left == 0, "ELECTION").when(left.between(1, blackout_days), "BLACKOUT").when(left.between(blackout_days + 1, campaign_days), "CAMPAIGN")
        .when(left > campaign_days, "PRE").when(left >= -post_days, "POST").when(left >= -recent_days, "RECENT").otherwise("ARCHIVED")
    )

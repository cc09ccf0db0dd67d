"""Filters on groups of poll rows and on text rules. Group rules are windows over the poll's columns: one shuffle each, shared when the columns are equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _total(value: str, poll: list[str]) -> Column:
    """A poll's sum, added in decimals: it doesn't hang on the order of rows, as a sum of doubles near a bound does. Beyond their range it is one of doubles."""
    w = Window.partitionBy(*poll)
    exact = F.col(value).try_cast("decimal(38,18)")
    wide = F.max(F.col(value).isNotNull() & (exact.isNull() | (F.abs(F.col(value)) >= 1e9))).over(w)
    return F.when(wide, F.sum(value).over(w)).otherwise(F.sum(F.when(F.abs(F.col(value)) < 1e9, exact)).over(w).cast("double"))


def scale_repair(df: DataFrame, poll: list[str], pct: str, least: float = 30, most: float = 110) -> DataFrame:
    """Sums of 700..1100 are per mille: divided by 10, one decimal. Then polls with a sum of 0, under least or over most go."""
    total = _total(pct, poll)
    fixed = df.withColumn(pct, F.when(total.between(700, 1100), F.round(F.col(pct) / 10, 1)).otherwise(F.col(pct)))
    fixed = fixed.withColumn("__sum", _total(pct, poll))
    return fixed.filter(F.col("__sum").between(least, most) & (F.col("__sum") != 0)).drop("__sum")


def over_sum(df: DataFrame, poll: list[str], pct: str, most: float = 113) -> DataFrame:
    """Polls whose shares add to more than `most` go."""
    return df.withColumn("__sum", _total(pct, poll)).filter(F.col("__sum") <= most).drop("__sum")


def both_present(df: DataFrame, poll: list[str], party: str, a: list[str], b: list[str]) -> DataFrame:
    """Polls that name a party of each set."""
    w = Window.partitionBy(*poll)
    return df.withColumn("__a", F.max(F.col(party).isin(a)).over(w)).withColumn("__b", F.max(F.col(party).isin(b)).over(w)).filter("__a AND __b").drop("__a", "__b")


def repeated_names(df: DataFrame, poll: list[str], name: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """Polls of `least` names or more, of which fewer than share are distinct, go."""
    stats = df.groupBy(*poll).agg(F.count(name).alias("__n"), F.count_distinct(name).alias("__d")).filter((F.col("__n") >= least) & (F.col("__d") < share * F.col("__n")))
    return df.join(stats.select(*poll), poll, "left_anti")


def crowded_party(df: DataFrame, poll: list[str], party: str, major: list[str], least: int = 4) -> DataFrame:
    """Polls with `least` candidates or more of one major party go."""
    crowded = df.filter(F.col(party).isin(major)).groupBy(*poll, party).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(*poll).distinct()
    return df.join(crowded, poll, "left_anti")


def single_party(df: DataFrame, poll: list[str], party: str, independent: str) -> DataFrame:
    """Polls go whose parties are all empty, or that name one real party and no independent."""
    p = F.coalesce(F.col(party), F.lit(""))
    real = (p != "") & (p != independent)
    stats = df.groupBy(*poll).agg(F.count_distinct(F.when(real, p)).alias("__real"), F.max(p == independent).alias("__ind"), F.max(p != "").alias("__any"))
    gone = stats.filter(~F.col("__any") | ((F.col("__real") == 1) & ~F.col("__ind"))).select(*poll)
    return df.join(gone, poll, "left_anti")


def multiway(df: DataFrame, poll: list[str], name: str, pct: str, least: int = 4, low: float = 70, high: float = 106, top: float = 55) -> DataFrame:
    """Polls of `least` named or more, summing to low..high, none at `top` or more: (poll, n, sum, max)."""
    named = F.coalesce(F.col(name), F.lit("")) != ""
    g = df.groupBy(*poll).agg(F.count_if(named).alias("n"), F.sum(pct).alias("sum"), F.max(pct).alias("max"))
    return g.filter((F.col("n") >= least) & F.col("sum").between(low, high) & (F.col("max") < top))


def mislabelled(df: DataFrame, poll: list[str], party: str, full: str, bare: str) -> DataFrame:
    """In polls that name `full`, rows of `bare` go."""
    return df.withColumn("__full", F.max(F.col(party) == full).over(Window.partitionBy(*poll))).filter(~(F.col("__full") & (F.col(party) == bare))).drop("__full")


def horse_race(df: DataFrame, poll: list[str], name: str, roster: DataFrame, anchors: list[str], low: int = 3, high: int = 6) -> DataFrame:
    """Registered candidates' rows of polls with low..high of them, at least one an anchor."""
    own = df.join(roster.select(name).distinct(), name, "left_semi")
    w = Window.partitionBy(*poll)
    return own.withColumn("__n", F.count("*").over(w)).withColumn("__a", F.max(F.col(name).isin(anchors)).over(w)).filter(F.col("__n").between(low, high) & F.col("__a")).drop("__n", "__a")


def any_rule(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found: one alternation."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that is found."""
    return F.coalesce(*[F.when(text.rlike(p), label) for p, label in rules], F.lit(default))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether the text, without white space, holds any of the words."""
    squeezed = F.regexp_replace(text, r"\s+", "")
    return reduce(lambda a, b: a | b, [F.contains(squeezed, F.lit(w)) for w in words])


def recent(df: DataFrame, day: str, now: str, days: int) -> DataFrame:
    """Rows at most `days` old; rows without a day stay."""
    return df.filter(F.col(day).isNull() | (F.datediff(F.lit(now).cast("date"), F.col(day)) <= days))


def in_period(df: DataFrame, day: str, election: str, start: str | None = None) -> DataFrame:
    """Rows from start, or a year before the election, up to the election."""
    last = F.lit(election).cast("date")
    return df.filter(F.col(day).between(F.lit(start).cast("date") if start else F.add_months(last, -12), last))


def before_blackout(df: DataFrame, day: str, start: str, end: str, now: str) -> DataFrame:
    """While now lies in the blackout, rows from its start on are hidden; rows without a day always are."""
    active = F.lit(now).cast("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return df.filter(F.col(day).isNotNull() & ~(active & (F.col(day) >= F.lit(start).cast("date"))))


def quotable(df: DataFrame, after: str, now: str) -> DataFrame:
    """Rows whose embargo is over; rows without one are free."""
    return df.filter(F.col(after).isNull() | (F.col(after) <= F.lit(now).cast("timestamp")))


def free_text(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose columns, joined, lower-cased and without white space, hold the query treated alike."""
    q = "".join(query.lower().split())
    return df.filter(F.contains(F.lower(F.regexp_replace(F.concat_ws("", *columns), r"\s+", "")), F.lit(q)))


def tiered_search(df: DataFrame, text: str, query: str, pos: list[str], n: int = 6) -> DataFrame:
    """Exact 0, prefix 1, substring 2: the best n by tier, then pos."""
    t, q = F.lower(F.col(text)), query.lower()
    tier = F.when(t == q, 0).when(F.startswith(t, F.lit(q)), 1).when(F.contains(t, F.lit(q)), 2)
    return df.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", *pos).limit(n)


def faceted(df: DataFrame, facets: dict[str, str | None], order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the given values (null: any), the first n in order, and in one row how many there are."""
    hit = reduce(lambda d, kv: d if kv[1] is None else d.filter(F.col(kv[0]) == kv[1]), facets.items(), df)
    return hit.orderBy(*order).limit(n), hit.agg(F.count("*").alias("total"))


def admitted(df: DataFrame, won: str, person: list[str], known: DataFrame, name: str, pct: str, least: float = 5.0) -> DataFrame:
    """Rows that won, or of a known person, or of a name in several races with at least `least`."""
    k = known.select(*person).distinct().withColumn("__known", F.lit(True))
    many = df.groupBy(name).agg(F.count("*").alias("__races"))
    j = df.join(k, person, "left").join(many, name, "left")
    return j.filter(F.coalesce(F.col(won), F.lit(False)) | F.col("__known").isNotNull() | ((F.col("__races") > 1) & (F.col(pct) >= least))).select(*df.columns)

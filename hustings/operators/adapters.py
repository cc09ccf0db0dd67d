"""Between result layouts: race documents, legacy rows, compositions, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.rollups import ratio


def flattened(races: DataFrame, keep: list[str], candidates: str = "candidates") -> DataFrame:
    """A row for each candidate of each race, with pos from 0; won is false where it is missing."""
    out = races.select(*keep, F.posexplode(candidates).alias("pos", "__c")).select(*keep, "pos", "__c.*")
    return out.withColumn("won", F.coalesce("won", F.lit(False))) if "won" in out.columns else out


def nested(rows: DataFrame, race: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Races with candidates as an array, in order of numeric columns."""
    item = F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.struct(*fields).alias("c"))
    return rows.groupBy(*race).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("candidates"))


def legacy(races: DataFrame, place: list[str]) -> DataFrame:
    """Legacy columns of races: place falls back over its columns, voters over voted, turnout in per cent (0 without electors)."""
    where = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in place], F.lit("nation"))
    voters = F.coalesce("voters", "voted")
    return races.select(where.alias("place"), "electors", voters.alias("voters"), ratio(voters.cast("double"), F.col("electors").cast("double")).alias("turnout"), "candidates")


def area_rows(df: DataFrame, area: list[str], level: str, key: list[str], votes: str, share: str, pos: list[str]) -> DataFrame:
    """Area shares by how fine the data are: `broadcast` takes the area's first row of each key, `area` the stored share, else parts are summed.

    level holds broadcast, area or part, and one area has one level.
    """
    w = Window.partitionBy(*area, *key).orderBy(*pos)
    stored = df.filter(F.col(level).isin("broadcast", "area")).withColumn("__k", F.row_number().over(w)).filter("__k = 1").select(*area, *key, F.col(share).alias("share"))
    summed = df.filter(F.col(level) == "part").groupBy(*area, *key).agg(F.sum(votes).alias("__v"))
    summed = summed.select(*area, *key, (F.col("__v") / F.sum("__v").over(Window.partitionBy(*area)) * 100).alias("share"))
    return stored.unionByName(summed)


def composition(df: DataFrame, round_: str, label: str, value: str, pos: list[str], most: int = 6) -> DataFrame:
    """Per round the `most` largest labels with their share of the round's total, and the rest as others."""
    summed = df.groupBy(round_, label).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(round_)
    ranked = summed.withColumn("__r", F.row_number().over(w.orderBy(F.col("v").desc(), label))).withColumn("__t", F.sum("v").over(w))
    name = F.when(F.col("__r") <= most, F.col(label)).otherwise("others")
    return ranked.groupBy(round_, name.alias(label), F.col("__t")).agg(F.sum("v").alias("v"), F.min("__r").alias("place")).select(round_, label, "place", (F.col("v") / F.col("__t") * 100).alias("share"))


def opacity(gap: Column) -> Column:
    """0.55 at no margin, towards 1 as it grows."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.5), 0.55 + 0.45 * (1 - F.exp(-F.abs(gap) / 10))))


def source_kind(wiki: Column, live: Column, official: Column) -> Column:
    """Where results come from: the first of wiki, live, nec that is there, else none."""
    return F.when(wiki, "wiki").when(live, "live").when(official, "nec").otherwise("none")


def neighbours_in_time(df: DataFrame, by: list[str], when: str, name: str, pos: list[str]) -> DataFrame:
    """Adds previous and next: names of the rows before and after in time."""
    w = Window.partitionBy(*by).orderBy(when, *pos)
    return df.withColumn("previous", F.lag(name).over(w)).withColumn("next", F.lead(name).over(w))


def title_of(df: DataFrame, by: list[str], office: str, order: list[str], won: str) -> DataFrame:
    """Per person the highest office won, by `order`, and how often."""
    at = F.coalesce(*[F.when(F.col(office) == o, F.lit(i)) for i, o in enumerate(order)])
    n = df.filter(F.col(won)).withColumn("__at", at).filter("__at IS NOT NULL").groupBy(*by, office, "__at").agg(F.count("*").alias("terms"))
    return n.groupBy(*by).agg(F.min_by(F.struct(office, "terms"), "__at").alias("b")).select(*by, "b.*")


def tie_broken(df: DataFrame, facts: DataFrame, on: list[str], row: str, kind: str, place: str, take: str) -> DataFrame:
    """The take of the only fact of equal `on`; of several, of the only one of equal kind; of several of these, of the least whose place the row's place contains."""
    f = facts.select(*on, F.col(kind).alias("__kind"), F.col(place).alias("__place"), F.col(take).alias("__take"))
    j = df.join(f, on)
    same = F.col(kind) == F.col("__kind")
    g = j.groupBy(row).agg(
        F.count("*").alias("__n"), F.min("__take").alias("__any"), F.count_if(same).alias("__k"), F.min(F.when(same, F.col("__take"))).alias("__one"),
        F.min(F.when(same & F.contains(F.col(place), F.col("__place")), F.col("__take"))).alias("__placed"),
    )
    return df.join(g.select(row, F.when(F.col("__n") == 1, F.col("__any")).when(F.col("__k") == 1, F.col("__one")).otherwise(F.col("__placed")).alias(take)), row, "left")

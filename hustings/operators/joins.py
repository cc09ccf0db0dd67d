"""Joins with more than equality: priorities, validity intervals, as-of, ordered fallbacks, containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a roster look-up; never collapse the last two to null.
REGISTERED, ABSENT, UNKNOWN = "registered", "absent", "unknown"


def backfill(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target, and the rows of source whose keys it lacks."""
    return target.unionByName(source.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def pending(registered: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """All registered rows with their results; is_pending where there is none. Of several results of a key the least row counts, so a row in is a row out."""
    values = [c for c in results.columns if c != key]
    one = results.groupBy(key).agg(F.min(F.struct(*values, F.lit(True).alias("__there"))).alias("__hit"))
    return registered.join(one, key, "left").select(*registered.columns, *[F.col(f"__hit.{c}").alias(c) for c in values], F.col("__hit").isNull().alias("is_pending"))


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that only one side has, and which side."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, keys, "full").filter("__a IS NULL OR __b IS NULL")
    return both.select(*keys, F.when(F.col("__b").isNull(), "left").otherwise("right").alias("only_in"))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Full-outer overlay: values of new where it has the key, but filled `keep` columns of old stay; state tells what happened."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in values], F.lit(True).alias("__old"))
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in values], F.lit(True).alias("__new"))
    j = o.join(n, keys, "full")
    has_new = F.col("__new").isNotNull()

    def pick(c: str) -> Column:
        kept = F.nullif(F.col(f"__o_{c}").cast("string"), F.lit("")).isNotNull() if c in keep else F.lit(False)
        return F.when(has_new & ~kept, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c)

    state = F.when(~has_new, "kept").when(F.col("__old").isNull(), "added").otherwise("updated")
    return j.select(*keys, *[pick(c) for c in values], state.alias("state"))


def priority_lookup(df: DataFrame, lookups: list[tuple[DataFrame, list[str], str]], out: str) -> DataFrame:
    """out: the value of the first look-up (table, keys, value) that has one. Tables have one row for each key; empty text is none."""
    found = df
    for i, (table, keys, value) in enumerate(lookups):
        found = found.join(table.select(*keys, F.nullif(F.col(value), F.lit("")).alias(f"__p{i}")), keys, "left")
    return found.withColumn(out, F.coalesce(*[F.col(f"__p{i}") for i in range(len(lookups))])).select(*df.columns, out)


def roster_status(df: DataFrame, roster: DataFrame, keys: list[str], present: str) -> DataFrame:
    """Adds status: registered, absent (looked up, confirmed not there) or unknown (never looked up). A key looked up more than once is registered if any
    look-up says so; a row in is a row out."""
    r = roster.groupBy(*keys).agg(F.max(present).alias("__present"))
    return df.join(r, keys, "left").withColumn("status", F.when(F.col("__present").isNull(), UNKNOWN).when(F.col("__present"), REGISTERED).otherwise(ABSENT)).drop("__present")


def within_term(df: DataFrame, terms: DataFrame, when: str, start: str, end: str, take: list[str], on: list[str] = [], half_open: bool = False) -> DataFrame:  # noqa: B006
    """Left interval join: the row of terms with start <= when <= end (or < end); a null end is open. Without `on`, terms must be a small dimension."""
    t = terms.select(*on, F.col(start).alias("__s"), F.col(end).alias("__e"), *take)
    upper = F.col(when) < F.col("__e") if half_open else F.col(when) <= F.col("__e")
    inside = (F.col(when) >= F.col("__s")) & (F.col("__e").isNull() | upper)
    if on:
        t = reduce(lambda x, c: x.withColumnRenamed(c, f"__k_{c}"), on, t)
        inside = reduce(lambda x, c: x & (F.col(c) == F.col(f"__k_{c}")), on, inside)
    return df.join(t, inside, "left").select(*df.columns, *take)


def as_of(df: DataFrame, eras: DataFrame, by: list[str], when: str, start: str, take: str) -> DataFrame:
    """The take of the last era of the same `by` that starts at or before each row, null before the first.

    Union and running last value: one shuffle on `by`, no range join. An era that starts at a row's own time counts.
    """
    row = df.select(*by, F.col(when).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(eras.schema[take].dataType).alias("__v"), F.struct(*df.columns).alias("__row"))
    era = eras.select(*by, F.col(start).cast(df.schema[when].dataType).alias("__t"), F.lit(0).alias("__kind"), F.col(take).alias("__v"), F.lit(None).cast(row.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return row.unionByName(era).withColumn(take, F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1").select("__row.*", take)


def name_by_upper_bound(df: DataFrame, eras: DataFrame, key: str, when: str, upper: str, name: str) -> DataFrame:
    """The name of the first era of the key whose upper bound lies after `when`; a key without one keeps its own name.

    The few eras of a key are one sorted list, so each row stays one row. A null upper bound is open; a null `when` is in open eras only.
    """
    era = F.struct(F.col(upper).isNull().alias("open"), F.col(upper).alias("u"), F.col(name).alias("n"))
    known = eras.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(era)).alias("__eras"))
    j = df.join(known, F.col(key) == F.col("__k"), "left")
    first = F.get(F.filter("__eras", lambda e: e["open"] | (F.col(when) < e["u"])), F.lit(0))
    return j.select(*df.columns, F.coalesce(first["n"], F.col(key).cast("string")).alias("name_then"))


def ordered_match(left: DataFrame, key: list[str], rules: list[DataFrame], merge: bool = False) -> DataFrame:
    """rules: for each rule, in order, (key, match) candidates. Each key keeps the candidates of its first rule that has any: the least match, or all if merge."""
    every = reduce(DataFrame.unionByName, [r.select(*key, "match").withColumn("rule", F.lit(i)) for i, r in enumerate(rules)])
    w = Window.partitionBy(*key)
    best = every.withColumn("__first", F.min("rule").over(w)).filter("rule = __first").drop("__first").distinct()
    if not merge:
        best = best.groupBy(*key).agg(F.min("rule").alias("rule"), F.min("match").alias("match"))
    return left.join(best, key, "left")


def longest_contained(df: DataFrame, text: str, bases: DataFrame, base: str, on: list[str]) -> DataFrame:
    """The longest base that each row's text holds, among bases of the same `on`; ties go to the name that sorts first.

    The bases of one `on` are a roster: they form one list, longest first, and each row stays one row.
    """
    b = bases.select(*on, F.col(base).alias("__base")).filter("__base IS NOT NULL").distinct()
    listed = b.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct((-F.length("__base")).alias("n"), F.col("__base").alias("t")))).alias("__bases"))
    longest = F.get(F.filter("__bases", lambda x: F.contains(F.col(text), x["t"])), F.lit(0))["t"]
    return df.join(listed, on, "left").select(*df.columns, longest.alias("base"))


def first_key_that_matches(df: DataFrame, keys: Column, table: DataFrame, key: str, take: str) -> DataFrame:
    """keys: an array of derived spellings. The take of the first one that the table has; of several rows of a spelling the least take."""
    known = table.groupBy(F.col(key).alias("__key")).agg(F.min(take).alias("__take"))
    spelt = df.select(keys.alias("__keys")).distinct()  # rows with the same spellings share a look-up
    hit = spelt.select("__keys", F.posexplode("__keys").alias("__pos", "__key")).join(known, "__key")
    hit = hit.groupBy("__keys").agg(F.min_by("__take", "__pos").alias(take), F.min("__pos").alias("used"))
    return df.withColumn("__keys", keys).join(hit, "__keys", "left").select(*df.columns, take, "used")


def positional(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """k-th row to k-th row of each group, only where both sides have as many."""
    w = Window.partitionBy(*by)
    a = left.withColumn("__k", F.row_number().over(w.orderBy(*left_order))).withColumn("__n", F.count("*").over(w))
    b = right.withColumn("__k", F.row_number().over(w.orderBy(*right_order))).withColumn("__n", F.count("*").over(w))
    return a.join(b, [*by, "__k", "__n"]).drop("__n").withColumnRenamed("__k", "place")


def consensus(df: DataFrame, by: list[str], month: Column, value: str, reference: DataFrame, most: float) -> DataFrame:
    """Rows within `most` of the reference (by, month, mean); rows without a reference stay."""
    j = df.withColumn("month", month).join(reference, [*by, "month"], "left")
    return j.filter(F.col("mean").isNull() | (F.abs(F.col(value) - F.col("mean")) <= most)).select(*df.columns)


def hit_rate(predicted: DataFrame, actual: DataFrame, keys: list[str], by: list[str], choice: str, value: str) -> DataFrame:
    """Per group: how often the predicted choice is the actual one, and the mean absolute error of the value."""
    a = actual.select(*keys, F.col(choice).alias("__c"), F.col(value).alias("__v"))
    return predicted.join(a, keys).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(choice) == F.col("__c")).cast("double")).alias("hit_rate"), F.avg(F.abs(F.col(value) - F.col("__v"))).alias("mae")
    )


def resolve_aliases(df: DataFrame, lifecycle: DataFrame, name: str, when: str, rounds: int = 16) -> DataFrame:
    """Follow names through time: lifecycle (name, since, until, before_as, after_as), a small dimension with one row a name.

    Before its since a name becomes before_as (null: hidden), from its until on after_as, again and again, at most `rounds` times.
    Only distinct pairs of name and time go through the rounds; one join takes what they become back to the rows, which all stay.
    """
    life = lifecycle.select(F.col("name").alias("__l"), "since", "until", "before_as", "after_as")
    pairs = df.select(F.col(name).alias("__name"), F.col(when).alias("__when")).distinct().withColumn("__to", F.col("__name"))
    for _ in range(rounds):
        j = pairs.join(life, F.col("__to") == F.col("__l"), "left")
        nxt = F.when(F.col("__when") < F.col("since"), F.col("before_as")).when(F.col("__when") >= F.col("until"), F.col("after_as")).otherwise(F.col("__to"))
        pairs = j.select("__name", "__when", nxt.alias("__to"))
    back = F.col(name).eqNullSafe(F.col("__name")) & F.col(when).eqNullSafe(F.col("__when"))
    return df.join(pairs, back, "left").select(*df.columns, F.col("__to").alias("resolved"))

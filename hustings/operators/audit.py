"""Data-quality checks; each is a DataFrame (check, severity, key, value), so they can be put together and compared over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.operators import dedup, joins


def finding(df: DataFrame, check: str, severity: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def inflation(df: DataFrame, contest: list[str], party: str, major: list[str], least: int = 4) -> DataFrame:
    n = df.filter(F.col(party).isin(major)).groupBy(*contest, party).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return finding(n, "party_inflation", "error", F.concat_ws("|", *contest, party), F.col("n"))


def party_as_name(df: DataFrame, name: str, parties: DataFrame, key: str) -> DataFrame:
    return finding(df.join(parties.select(F.col(parties.columns[0]).alias(name)).distinct(), name, "left_semi"), "party_as_name", "error", F.col(key), F.col(name))


def sum_sanity(df: DataFrame, poll: list[str], pct: str, least: float = 30, most: float = 110) -> DataFrame:
    s = df.groupBy(*poll).agg(F.round(F.sum(pct), 2).alias("s")).filter((F.col("s") < least) | (F.col("s") > most))
    return finding(s, "sum_sanity", "warn", F.concat_ws("|", *poll), F.col("s"))


def office_mismatch(df: DataFrame, unit: list[str], office: str, expected: str, pos: list[str]) -> DataFrame:
    top = dedup.mode(df, unit, office, pos).join(df.select(*unit, expected).distinct(), unit).filter(F.col(office) != F.col(expected))
    return finding(top, "office_mismatch", "warn", F.concat_ws("|", *unit), F.concat_ws(">", expected, office))


def roster_gaps(df: DataFrame, poll: list[str], name: str, status: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Names confirmed absent that appear `least` times or more among rows of polls, registered in at least `share` of all rows of these polls."""
    per_poll = df.groupBy(*poll).agg(F.count("*").alias("__n"), F.count_if(F.col(status) == joins.REGISTERED).alias("__reg"))
    absent = df.filter(F.col(status) == joins.ABSENT).join(per_poll, poll).groupBy(name).agg(F.count("*").alias("n"), (F.sum("__reg") / F.sum("__n")).alias("ratio"))
    return finding(absent.filter((F.col("n") >= least) & (F.col("ratio") >= share)), "roster_gap", "warn", F.col(name), F.col("n"))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "severity").agg(F.count("*").alias("count"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts by check of two runs and their difference; a check that one run lacks counts 0."""
    o, n = old.groupBy("check").agg(F.count("*").alias("before")), new.groupBy("check").agg(F.count("*").alias("after"))
    j = o.join(n, "check", "full")
    return j.select("check", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def exit_code(findings: DataFrame, strict: bool = False) -> DataFrame:
    bad = F.col("severity").isin(["error", "warn"] if strict else ["error"])
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"), F.when(F.count_if(bad) > 0, 1).otherwise(0).alias("exit_code"))


def funnel(ids: DataFrame, key: str, parsed: DataFrame, results: DataFrame, images: DataFrame) -> DataFrame:
    """(class, n): ok (parsed and in results), leak (parsed only), image, parse_fail (a result is there, nothing parsed), no_result."""
    flag = lambda d, c: d.select(key).distinct().withColumn(c, F.lit(True))
    j = ids.select(key).join(flag(parsed, "p"), key, "left").join(flag(results, "r"), key, "left").join(flag(images, "i"), key, "left")
    cls = F.when(F.col("p") & F.col("r"), "ok").when(F.col("p"), "leak").when(F.col("i"), "image").when(F.col("r"), "parse_fail").otherwise("no_result")
    return j.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


def completeness(manifest: DataFrame, files: DataFrame, key: str, kind: str) -> DataFrame:
    """Per kind: files of the manifest, and how many of them aren't there."""
    gone = manifest.join(files.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return gone.groupBy(kind).agg(F.count("*").alias("listed"), F.count_if(F.col("__there").isNull()).alias("missing"))


def match_rate(df: DataFrame, hit: Column, least: float) -> float:
    """The share of rows that hit; ValueError below `least`: call it before a write."""
    r = df.agg(F.count("*").alias("n"), F.count_if(hit).alias("h")).first()
    rate = r["h"] / r["n"] if r["n"] else 1.0
    if rate < least:
        raise ValueError(f"only {rate:.1%} of the rows match; {least:.0%} are asked for")
    return rate

"""Writers: split tables, merges, upserts, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_stats(df: DataFrame, path: str, stats: list[Column]) -> None:
    """Overwrite a JSON table, and beside it a one-row table of statistics."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.agg(*stats).write.mode("overwrite").json(f"{path}/meta")


def chunk(scope: Column, kind: Column, core: dict[str, list[str]]) -> Column:
    """core or drill: whether the scope is among the kind's core scopes (the kinds not listed: all are core)."""
    out = F.lit("core")
    for k, scopes in core.items():
        out = F.when(kind == k, F.when(scope.isin(scopes), "core").otherwise("drill")).otherwise(out)
    return out


def split(df: DataFrame, path: str, part: Column) -> None:
    """Overwrite a table in folders by chunk, so that readers of the core read no drill rows; running it again gives the same."""
    df.withColumn("chunk", part).write.mode("overwrite").partitionBy("chunk").parquet(path)


def incremental(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new with unseen keys."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """new over old by key; of a key in both, filled `keep` columns of old stay. One row a key on each side."""
    values = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*values).alias("__o"))
    n = new.select(*key, F.struct(*values).alias("__n"))
    j = o.join(n, key, "full")

    def pick(c: str) -> Column:
        was, now = F.col(f"__o.{c}"), F.col(f"__n.{c}")
        stays = F.nullif(was.cast("string"), F.lit("")).isNotNull() if c in keep else F.lit(False)
        return F.when(F.col("__n").isNull() | stays, was).otherwise(now)

    return j.select(*key, *[pick(c).alias(c) for c in values])


def guarded(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, but for keys of which new has none, rows of old: a filled result is never replaced by nothing."""
    return new.select(*old.columns).unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def replaced(old: DataFrame, new: DataFrame, match: Column) -> DataFrame:
    """old without the rows that match, and new."""
    return old.filter(~F.coalesce(match, F.lit(False))).unionByName(new.select(*old.columns))


def lite(df: DataFrame, path: str, keep: Column, columns: list[str]) -> None:
    """Overwrite a smaller table: the rows to keep, with the named columns only."""
    df.filter(keep).select(*columns).write.mode("overwrite").parquet(path)


def to_scan(candidates: DataFrame, scanned: DataFrame, key: list[str], version: str) -> DataFrame:
    """Candidates never scanned, or scanned in another version: scans without a result are remembered too and not repeated."""
    return candidates.join(scanned.select(*key, version).distinct(), [*key, version], "left_anti")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def rounded(coordinates: Column, digits: int = 6) -> Column:
    """array<array<double>> with rounded numbers."""
    return F.transform(coordinates, lambda p: F.transform(p, lambda x: F.round(x, digits)))

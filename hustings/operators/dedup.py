"""Cleaning and deduplication of poll-like records. Ties are settled by `pos`."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.workers import importable


def first_source(parts: list[DataFrame], key: list[str], pos: list[str]) -> DataFrame:
    """Union in order of priority; each key keeps its row of the first part that has it."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__prio", F.lit(i)) for i, p in enumerate(parts)])
    names = [c for c in every.columns if c != "__prio"]
    best = every.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct("__prio", *[F.struct(F.col(p).isNotNull(), F.col(p)) for p in pos])).alias("__best"))
    return best.select("__best.*")


def best_card(df: DataFrame, key: list[str], score: list[Column], pos: list[str]) -> DataFrame:
    """One row a key: the largest score tuple, then the first by pos."""
    w = Window.partitionBy(*key).orderBy(*[s.desc_nulls_last() for s in score], *pos)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def max_by_label(df: DataFrame, record: list[str], label: list[str], value: str, pos: list[str]) -> DataFrame:
    """In each record one row a label, with the largest value; rows with all labels blank are kept as they are."""
    blank = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in label])
    w = Window.partitionBy(*record, *label).orderBy(F.col(value).desc_nulls_last(), *pos)
    return df.withColumn("__rank", F.when(blank, 1).otherwise(F.row_number().over(w))).filter("__rank = 1").drop("__rank")


def by_signature(df: DataFrame, record: list[str], header: list[str], items: list[str], pos: list[str]) -> DataFrame:
    """Records (record columns) whose header and sorted items are equal: the first by pos stays. One row a record."""
    sig = df.groupBy(*record, *header).agg(F.array_sort(F.collect_list(F.struct(*items))).alias("__items"))
    sig = sig.withColumn("signature", F.sha2(F.to_json(F.struct(*header, "__items")), 256)).drop("__items")
    rank = F.row_number().over(Window.partitionBy("signature").orderBy(*pos))
    return sig.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "signature")


def mode(df: DataFrame, by: list[str], value: str, pos: list[str]) -> DataFrame:
    """Most frequent value of each group, its count and the group's; ties go to the value seen first by pos (numeric)."""
    first = F.min(pos[0]) if len(pos) == 1 else F.min(F.struct(*pos))  # a plain value aggregates by hash, a struct by sort
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), first.alias("__first"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("__rank", F.row_number().over(w.orderBy(F.col("n").desc(), "__first")))
    return ranked.filter("__rank = 1").select(*by, value, "n", "total")


def qualified_mode(df: DataFrame, by: list[str], value: str, pos: list[str]) -> DataFrame:
    """mode(), only where it is alone or has at least twice the rest."""
    return mode(df, by, value, pos).filter("n = total OR n >= 2 * (total - n)")


def supported(df: DataFrame, key: list[str], source: str, least: int) -> DataFrame:
    """Keys seen by at least `least` distinct sources."""
    return df.groupBy(*key).agg(F.count_distinct(source).alias("n_sources")).filter(F.col("n_sources") >= least)


def unique_or_null(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The group's value if it has exactly one, else null."""
    return df.groupBy(*by).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def snapped_names(df: DataFrame, by: list[str], name: str, rare: int = 3, most_names: int = 3) -> DataFrame:
    """(by, name, snapped): a name seen fewer than `rare` times becomes the group's most frequent name (seen at least `rare` times) if lengths
    differ by at most 1 and one is the other's start or end, or they differ in at most one place; only in groups of fewer than `most_names` names."""
    counts = df.groupBy(*by, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    top = counts.withColumn("__k", F.row_number().over(w.orderBy(F.col("n").desc(), name))).withColumn("__names", F.count("*").over(w))
    top = top.withColumn("__top", F.first(name).over(w.orderBy("__k"))).withColumn("__top_n", F.first("n").over(w.orderBy("__k")))
    a, b = F.col(name), F.col("__top")
    near = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    hamming = (F.length(a) == F.length(b)) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda acc, i: acc + (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))).cast("int")) <= 1)
    snap = (F.col("n") < rare) & (F.col("__top_n") >= rare) & (F.col("__names") < most_names) & (F.abs(F.length(a) - F.length(b)) <= 1) & (near | hamming)
    return top.select(*by, name, F.when(snap, b).otherwise(a).alias("snapped"))


def bleed_repair(df: DataFrame, by: list[str], name: str, lengths: tuple[int, int] = (4, 5)) -> DataFrame:
    """(by, name, repaired): a name of those lengths loses its last character if what is left occurs at least twice and more often than itself."""
    counts = df.groupBy(*by, name).agg(F.count("*").alias("n"))
    base = counts.select(*by, F.col(name).alias("__base"), F.col("n").alias("__n"))
    j = counts.withColumn("__base", F.expr(f"substring({name}, 1, length({name}) - 1)")).join(base, [*by, "__base"], "left")
    cut = F.length(name).between(*lengths) & (F.col("__n") >= 2) & (F.col("__n") > F.col("n"))
    return j.select(*by, name, F.when(cut, F.col("__base")).otherwise(F.col(name)).alias("repaired"))


def known_candidates(df: DataFrame, poll: list[str], name: str, known: DataFrame, party: str | None = None, plain: str = r"^\p{L}{2,4}$") -> DataFrame:
    """Polls of which fewer than 2 named candidates are known go, if they name at least 2; not if (party given) each named one has a party and a plain name."""
    k = known.select(name).distinct().withColumn("__known", F.lit(1))
    j = df.join(k, name, "left")
    w = Window.partitionBy(*poll)
    is_named = F.coalesce(F.col(name), F.lit("")) != ""
    named = F.sum(is_named.cast("int")).over(w)
    full = F.min(F.coalesce(~is_named | (F.col(name).rlike(plain) & (F.coalesce(F.col(party), F.lit("")) != "")), F.lit(False))).over(w) if party else F.lit(False)
    return j.withColumn("__named", named).withColumn("__hits", F.sum(F.coalesce("__known", F.lit(0))).over(w)).withColumn("__full", full).filter("__full OR NOT (__named >= 2 AND __hits < 2)").select(*df.columns)


def reclassified(df: DataFrame, unit: list[str], office: str, pos: list[str], known: Column) -> DataFrame:
    """Rows of a unit take the office that its known rows vote for by a qualified majority; without one they keep their own."""
    vote = qualified_mode(df.filter(known), unit, office, pos).select(*unit, F.col(office).alias("__office"))
    return df.join(vote, unit, "left").withColumn(office, F.coalesce("__office", office)).drop("__office")


def party_support(df: DataFrame, poll: list[str], party: str, value: str, majors: list[str], most: float = 65, low: float = 20, high: float = 102) -> DataFrame:
    """(poll, party, value): each party's largest value, of polls where none is over `most`, their sum is low..high and all majors are there."""
    best = df.groupBy(*poll, party).agg(F.max(value).alias(value))
    w = Window.partitionBy(*poll)
    total, top, there = F.sum(value).over(w), F.max(value).over(w), F.size(F.array_intersect(F.collect_set(party).over(w), F.array(*map(F.lit, majors))))
    return best.withColumns({"__total": total, "__top": top, "__there": there}).filter(F.col("__total").between(low, high) & (F.col("__top") <= most) & (F.col("__there") == len(majors))).select(*poll, party, value)


def continued(df: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adds run: neighbouring rows with equal `same` columns have one number, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = ~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same]) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w)).drop("__new")


class _Values:
    """The clusters that have a label, with their values, in arrays that grow."""

    def __init__(self, dtype):
        self.n, self.cluster, self.value = 0, np.empty(4, np.int64), np.empty(4, dtype)

    def add(self, cluster: int, value) -> None:
        if self.n == len(self.cluster):
            self.cluster, self.value = np.resize(self.cluster, 2 * self.n), np.resize(self.value, 2 * self.n)
        self.cluster[self.n], self.value[self.n] = cluster, value
        self.n += 1

    def split(self, value, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Clusters that agree with the value, and those that don't."""
        near = (np.abs(self.value[: self.n] - value) <= tolerance).astype(bool)
        return self.cluster[: self.n][near], self.cluster[: self.n][~near]


def agreement_merge(df: DataFrame, group: list[str], record: str, label: str, value: str, tolerance: float = 1.0) -> DataFrame:
    """Records of a group are merged greedily, in order of record: into the first cluster that shares a label with it and whose shared values
    differ by at most the tolerance; a cluster keeps the largest value of each label. Output: group, cluster, label, value.

    Greedy order is sequential by nature, so a group is worked on by one task; groups are one contest's records. A record is compared with all clusters that
    have its labels at once, label by label.
    """
    import pandas as pd

    importable(df.sparkSession)
    out = f"{', '.join(f'{c} {df.schema[c].dataType.simpleString()}' for c in group)}, cluster long, {label} {df.schema[label].dataType.simpleString()}, {value} double"

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.groupby([record, label], sort=True)[value].max()
        of, labels, values = best.index.codes[0], best.index.get_level_values(1), best.to_numpy()
        clusters: list[dict] = []  # label -> its place in the label's arrays
        known: dict[object, _Values] = {}
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)] if len(of) else []
        for lo, hi in pairwise(cuts):
            own = list(zip(labels[lo:hi], values[lo:hi], strict=True))
            sides = [known[k].split(v, tolerance) for k, v in own if k in known]
            able = np.concatenate([s[0] for s in sides]) if sides else np.empty(0, np.int64)
            if len(sides) > 1 and len(able):
                able = able[~np.isin(able, np.concatenate([s[1] for s in sides]))]
            c = int(able.min()) if len(able) else len(clusters)
            if c == len(clusters):
                clusters.append({})
            for k, v in own:
                at = clusters[c].get(k)
                held = known.setdefault(k, _Values(values.dtype))
                if at is None:
                    clusters[c][k] = held.n
                    held.add(c, v)
                else:
                    held.value[at] = max(held.value[at], v)
        rows = [(*key, i, k, float(known[k].value[at])) for i, c in enumerate(clusters) for k, at in sorted(c.items())]
        return pd.DataFrame(rows, columns=[*group, "cluster", label, value])

    return df.groupBy(*group).applyInPandas(merge, out)


def keyed_merge(parts: list[DataFrame], key: Column, values: list[str]) -> DataFrame:
    """Rows of several sources with an equal key become one: for each value the first source's that has one. A null key merges with none."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__prio", F.lit(i)) for i, p in enumerate(parts)]).withColumn("__key", key)
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__prio"))).alias(c) for c in values]
    return every.filter("__key IS NOT NULL").groupBy(F.col("__key").alias("key")).agg(*firsts, F.count("*").alias("n_rows"))


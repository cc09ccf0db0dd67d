r"""Mixing sources to target weights, in DataFrame functions only.

A document's size is its number of words [^\x20\x09-\x0D]+. Sources, by code point with null last, have repeating weights and share a
budget, `percent` of all sizes; a source's target stops at `most` times its size, and what is over goes to the others by weight until none is above.

Whole documents are taken. A source's documents are all taken as often as its target holds its size; the rest of the target goes to documents whose hash is
below the source's threshold, so a larger target only adds documents to what a smaller one takes. Thresholds come from histograms:

1. Documents get a hash of 60 bits of their id and text; sizes are summed by source and the hash's first 15 bits, and running sums tell the
   bucket in which the budget ends.
2. Only the documents of that bucket are looked at again, by their next 15 bits, and so on; they are a few in 100,000, and are written apart.
3. What is left at the end is one document, which is taken if that brings the sum nearer to the target (half its size or more fits), or equal rows, of which
   as many are taken as fit; which ones is settled by the same histograms over row numbers.
4. The documents are filtered by their source's threshold, without sorting. Each source's sum is within half a document of its target.

Null texts have size 0. Rows that share an id have hashes of their own unless their texts are equal too; then they are interchangeable and which of
them are taken makes no difference. A null id counts as an id. Sources of size 0 have target 0. Results depend on (id, text, source) alone, so
reruns agree. An empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.ranges import numbered
from hustings.workers import temporary, written

WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2
#: Bits of a hash, and of one step of a histogram.
BITS, STEP = 60, 15
MOST_ROUNDS = 200


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of an MD5."""
    seen = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(seen), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), the empty key coming last: shares by weight, none above `most` sizes, the excess shared again by weight.

    Shares stay in proportion to the weights, so a round finds the sources that are full at the present rate; the rate only rises. Three
    numbers a round reach the driver.
    """
    ranked = numbered(sizes, [F.nullif(F.col("source"), F.lit("")).asc_nulls_last()], "place")
    ranked = written(ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int")).cast("long")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # 100 * rate = left / open weights; a source is full if its share at this rate reaches its limit
    left, open_weight = percent * total, ranked.agg(F.sum("weight")).first()[0] or 0
    for _ in range(MOST_ROUNDS):
        full = F.lit(left).cast("decimal(38, 0)") * F.col("weight") >= F.lit(100 * most).cast("decimal(38, 0)") * F.col("source_size") * F.lit(open_weight)
        held = ranked.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("weight")).first()
        new = (percent * total - 100 * most * (held["size"] or 0), held["weight"] or 0)
        if new == (left, open_weight) or not new[1]:
            break
        left, open_weight = new
    else:
        raise RuntimeError(f"targets did not settle in {MOST_ROUNDS} rounds")
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(100.0 * max(open_weight, 1))
    return ranked.select("source", "source_size", F.when(full, F.col("source_size") * float(most)).otherwise(share).alias("target"))


def _ends(rows: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Of (source, key, size) and (source, budget): where each budget ends, (source, key, before): the key (60 bits) whose rows bring the running
    sum over the budget, and the sum of the rows below it. No row for a source whose budget holds all its rows or none."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("before"))
    for shift in range(BITS - STEP, -1, -STEP):
        prefix = F.shiftright(F.col(key), shift)
        if shift == BITS - STEP:  # all rows: summed first
            sums = rows.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("sum")).join(state, "source")  # at most 2^STEP a source
        else:  # those of one bucket, which carry what is left of their budget
            sums = rows.groupBy("source", "budget", "before", prefix.alias("prefix")).agg(F.sum("size").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("source").orderBy("prefix"))
        over = sums.withColumn("inner", upto - F.col("sum")).filter((F.col("inner") <= F.col("budget")) & (F.col("inner") + F.col("sum") > F.col("budget")))
        state = over.select("source", "prefix", (F.col("budget") - F.col("inner")).alias("budget"), (F.col("before") + F.col("inner")).alias("before"))
        if shift:
            rows = written(rows.select("source", key, "size").join(state, "source").filter(prefix == F.col("prefix")).drop("prefix"), "refined")
    return written(state.select("source", F.col("prefix").alias(key), "before"), "boundaries")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its id, size, source, source_size, target (its source's), copies, taken (copies * size)."""
    with temporary(docs.sparkSession) as keep:
        # a null source is the empty key; others have a letter before them
        named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
        sized = docs.select(F.col(id_col).alias("id"), named.alias("source"), words(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("hash"))
        sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
        goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
        goals = goals.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        goals = written(goals.withColumn("budget", F.col("target") - F.col("full") * F.col("source_size")), "targets")
        ends = _ends(sized.select("source", "hash", "size"), goals, "hash")

        # rows at the end of a budget are alike, and nearly always there is one: how many of them are taken
        last = sized.filter("size > 0").join(ends, ["source", "hash"]).join(goals.select("source", "budget"), "source")
        counted = last.groupBy("source", "hash").agg(F.count("*").alias("n"), F.max("size").alias("s"), F.max(F.col("budget") - F.col("before")).alias("room"))
        fit = F.floor((2 * F.col("room") - F.col("s")) / (2 * F.col("s"))) + 1
        counted = written(counted.select("source", "hash", "n", F.greatest(F.lit(0), F.least("n", fit)).cast("long").alias("fit")), "ends")
        some = counted.filter("fit > 0 AND fit < n")
        if some.isEmpty():
            until = some.select("source", F.lit(0).cast("long").alias("until"))
        else:  # the first `fit` by number
            alike = written(sized.filter("size > 0").join(some.select("source", "hash"), ["source", "hash"]).select("source", "row", F.lit(1).alias("size")), "alike")
            until = _ends(alike, some.select("source", F.col("fit").alias("budget")), "row").select("source", F.col("row").alias("until"))
        limits = goals.join(counted.withColumnRenamed("hash", "limit"), "source", "left").join(until, "source", "left")
        limits = written(limits.select("source", "source_size", "target", "full", "limit", "n", "fit", "until"), "limits")
        at_end = F.when(F.col("until").isNotNull(), F.col("row") < F.col("until")).otherwise(F.col("fit") == F.col("n"))
        more = F.when(F.col("hash") < F.col("limit"), True).when(F.col("hash") == F.col("limit"), at_end).otherwise(False)
        copies = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + more.cast("long"))
        out = sized.join(limits, "source").withColumns({"copies": copies, "source": F.when(F.col("source") != "", F.expr("substring(source, 2)"))})
        return keep(written(out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), "mixed"))

"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

1. Every row gets the SHA-256 of its normalised text; (id, digest) alone is written to the shared folder.
2. A Misra-Gries family summary (Spark's approx_top_k, mergeable, at most `tracked` counters per task) names the digests
   that may be frequent. Its counts are not used.
3. Those few digests are counted exactly, and the row that stays in each is found, by an ordinary aggregation with
   map-side partial results. The verified winners, at most `heavy` rows, are broadcast.
4. Rows with a heavy digest are settled map-side against the broadcast; all other digests take the ordinary shuffle.

Null text counts as empty, so null and empty texts are equal. A null id is smaller than any other. Where rows repeat with
the same id, one of them stays. An empty table gives an empty result. Extra columns are kept (deduplicate) or ignored
(annotate) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.batches import quoted
from hustings.workers import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digests that the broadcast may hold, and counters that the summary keeps.
HEAVY, TRACKED = 256, 4096
D, R, ID = "__dedup_digest", "__dedup_row", "__dedup_id"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _heavy(digests: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """At most `heavy` rows (digest, winner, group size), exact: candidates come from the summary, counts from the rows."""
    found = digests.agg(F.expr(f"approx_top_k({D}, {heavy}, {tracked})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias(D))
    return digests.join(F.broadcast(found), D, "left_semi").groupBy(D).agg(F.max(F.struct(ID, R)).alias("winner"), F.count("*").alias("size")).filter("size > 1")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = written(docs.select(F.col(id_col).alias(ID), F.sha2(normalised(F.col(text_col)), 256).alias(D)).withColumn(R, F.monotonically_increasing_id()), "digests")
    winners = written(_heavy(digests, heavy, tracked), "winners").select(D, F.col("winner").alias("w"), F.col("size").alias("n"))
    both = digests.join(F.broadcast(winners), D, "left")
    hot = both.filter("w IS NOT NULL")
    group = Window.partitionBy(D)
    cold = both.filter("w IS NULL").withColumns({"w": F.max(F.struct(ID, R)).over(group), "n": F.count("*").over(group)})
    return hot.unionByName(cold).select(
        F.col(ID).alias(id_col), F.col(f"w.{ID}").alias("keep_id"), F.col("n").alias("group_size"), (F.col(f"w.{R}") == F.col(R)).alias("kept"), F.col(D).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest id.

    Losing copies of heavy digests leave before the shuffle. What is left of a heavy digest (rows that share the winner's id), and all others, are settled
    by rank; a task sends one row of a digest at most, for the rank is pruned before the shuffle.
    """
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(R)
    rows = docs.select(F.col(quoted(id_col)).alias(ID), F.sha2(normalised(F.col(quoted(text_col))), 256).alias(D), row)
    digests = written(rows.select(ID, D).withColumn(R, F.monotonically_increasing_id()), "digests")
    winners = written(_heavy(digests, heavy, tracked), "winners").select(D, F.col(f"winner.{ID}").alias("keep"), F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(winners), D, "left").filter(F.col("heavy").isNull() | F.col(ID).eqNullSafe(F.col("keep")))
    first = F.row_number().over(Window.partitionBy(D).orderBy(F.col(ID).desc_nulls_last()))
    return rows.withColumn("rank", first).filter("rank = 1").select(*[F.col(f"{R}.{quoted(c)}").alias(c) for c in docs.columns])

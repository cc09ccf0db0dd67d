"""Incremental twins of batch operators: the same rows, however the input is cut into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.workers import remove, scratch


def source(spark: SparkSession, folder: str, name: str, schema, per_batch: int = 1) -> DataFrame:
    """Files of a folder that match name, as a stream; files seen are remembered by the checkpoint."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def drained(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run the stream over all there is, into a table in the shared folder, and read that. With the path of a run before it goes on where that ended."""
    spark = stream.sparkSession
    path = path or scratch(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def first_seen(stream: DataFrame, key: list[str], when: str, delay: str) -> DataFrame:
    """The first row of each key to arrive; keys are remembered for `delay` of event time."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark(key)


def sessions(stream: DataFrame, by: list[str], when: str, gap: str, delay: str) -> DataFrame:
    """(by, start, end, n) of sessions parted by more than the gap; a session is given out once no late row can join it."""
    w = F.session_window(when, gap)
    return stream.withWatermark(when, delay).groupBy(*by, w).agg(F.count("*").alias("n"), F.max(when).alias("last")).select(*by, F.col("session_window.start").alias("start"), F.col("last").alias("stop"), "n")


def late_results(registered: DataFrame, results: DataFrame, key: str, registered_at: str, result_at: str, wait: str) -> DataFrame:
    """Registered rows with the result that comes within `wait` of them; without one they are given out, pending, when the wait is over."""
    a = registered.withWatermark(registered_at, wait).alias("a")
    b = results.withWatermark(result_at, wait).alias("b")
    on = F.expr(f"a.{key} = b.{key} AND b.{result_at} >= a.{registered_at} AND b.{result_at} <= a.{registered_at} + interval {wait}")
    return a.join(b, on, "left_outer").select(f"a.{key}", f"a.{registered_at}", f"b.{result_at}", F.col(f"b.{result_at}").isNull().alias("is_pending"))


def windowed_counts(stream: DataFrame, by: list[str], when: str, size: str, slide: str, delay: str) -> DataFrame:
    """(by, start, n, mean) of sliding windows, given out when the watermark has passed them."""
    w = F.window(when, size, slide)
    return stream.withWatermark(when, delay).groupBy(*by, w).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(*by, F.col("window.start").alias("start"), "n", "mean")


def completeness(stream: DataFrame, by: list[str], pct: str, name: str, least: float = 98.0, mean: float = 99.5) -> DataFrame:
    """Counting state after the last batch: final when the least share reaches `least` and the mean `mean`.

    Each batch writes a snapshot of its own; the one before goes when the new one is whole, so there is always one to read.
    """
    out = stream.groupBy(*by).agg(F.min(pct).alias("least"), F.avg(pct).alias("mean"))
    out = out.withColumn("is_final", F.coalesce((F.col("least") >= least) & (F.col("mean") >= mean), F.lit(False)))
    path = scratch(stream.sparkSession, f"stream-{name}")

    last = [-1]

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows-{number}")
        if last[0] not in (-1, number):
            remove(batch.sparkSession, f"{path}/rows-{last[0]}")
        last[0] = number

    query = out.writeStream.foreachBatch(replace).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(out.schema).parquet(f"{path}/rows-{last[0]}") if last[0] >= 0 else spark.createDataFrame([], out.schema)


def merged(stream: DataFrame, path: str, key: list[str], name: str) -> None:
    """Append rows with unseen keys to a Parquet table, batch by batch; a batch that runs again adds nothing twice. Null keys are keys."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            there = spark.read.parquet(path).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(key)])
            fresh = fresh.join(there, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(key)], "left_anti")
        fresh.write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", scratch(stream.sparkSession, f"merge-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()

"""The driver's tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With the votes, unique in lineitem.
POS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests are orders, options their lines, votes the quantity."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *POS, "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their supplier's nation and region; nation and region have a fixed, small number of rows."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    return options(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll points: events, with a day, an agency and a sample size."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("day"), "user_id", (F.col("user_id") % 20).alias("agency"), F.col("event_type").alias("party"), F.col("value").alias("pct"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


PLACED_SQL = """placed as (select l.*, n_name, r_name from lineitem l join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
POLLS_SQL = """polls as (select event_id, ts, cast(ts as date) as day, user_id, user_id % 20 as agency, event_type as party, value as pct,
  cast(json_extract_string(props, '$.k') as bigint) as k from events)"""

"""Places in a global order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.workers import written

#: Bits of monotonically_increasing_id that number the rows of a partition.
LOW = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: each row's place from 0 in the order. Ranges of it are sorted apart, and only their sizes, a row a range, meet in one task.

    Rows that are equal in all of `order` lie in one range, so it should end with something that tells them apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("__part", F.shiftright("__at", LOW)), "ranged")  # numbers are fixed once written
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranged.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__at") - F.shiftleft(F.col("__part"), LOW)).drop("__part", "__at", "__start")


def running_max(df: DataFrame, group: list[str], place: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Adds `name`: the greatest value of the group's rows up to this one in the order of place (a global number). Blocks of places are worked on
    apart, so a group of any size is spread over tasks; only one number a block and group is handed on."""
    cut = df.withColumn("__block", F.floor(F.col(place) / block))
    own = cut.withColumn("__own", F.max(value).over(Window.partitionBy(*group, "__block").orderBy(place)))
    most = cut.groupBy(*group, "__block").agg(F.max(value).alias("__most"))
    before = most.withColumn("__before", F.max("__most").over(Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).filter("__before IS NOT NULL")
    return own.join(before.drop("__most"), [*group, "__block"], "left").withColumn(name, F.greatest("__own", "__before")).drop("__block", "__own", "__before")

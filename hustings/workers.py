"""What Python workers and written intermediate tables need to know about the session."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed but only lies on the driver's path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: Where spark.checkpoint.dir is unset, as in tests on one machine; removed when the process ends.
LOCAL = f"/tmp/hustings-{os.getpid()}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) a local one where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
    atexit.register(shutil.rmtree, LOCAL, ignore_errors=True)
    return f"file://{LOCAL}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it holds data of this application only."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediates through Hadoop's file system, which reaches any store that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Paths of tables written in the blocks of `temporary` that are open, by block.
_open: list[dict[str, DataFrame]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `written` makes in the block are deleted at its end, save those given to what the block gets (keep)."""
    made: dict[str, DataFrame] = {}

    def keep(df: DataFrame) -> DataFrame:
        for path in [p for p, t in made.items() if t is df]:
            del made[path]
            if len(_open) > 1:  # an outer block still has it
                _open[-2][path] = df
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.pop()
        remove(spark, *made)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1][path] = table
    return table

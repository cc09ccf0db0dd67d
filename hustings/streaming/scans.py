"""Scans worth doing, as state of a stream: results that weren't there are remembered, too, and not looked for again before time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which state with timers needs; it is checkpointed to the shared folder."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


class _Scans(StatefulProcessor):
    """State of a key: the version that was scanned last, and when. A timer clears it when it is too old to count."""

    def __init__(self, key: str, days: float):
        self.key, self.wait = key, timedelta(days=days)

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version string, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = sorted(pair for b in rows for pair in zip(b["at"].to_numpy().astype("datetime64[us]").tolist(), b["version"], strict=True))
        version, at = self.last.get() or (None, None)
        before, out = at, []
        for t, v in asked:
            if at is None or v != version or t > at + self.wait:
                version, at = v, t
                out.append((key[0], version, t))
        if out:
            self.last.update((version, at))
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(at))
            keys, versions, times = zip(*out, strict=True)
            yield pd.DataFrame({self.key: keys, "version": versions, "at": np.array(times, "datetime64[us]").astype("datetime64[ns]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass

    def _due(self, at) -> int:
        return int(at.replace(tzinfo=UTC).timestamp() * 1000 + self.wait.total_seconds() * 1000) + 1


def due(candidates: DataFrame, key: str, version: str, when: str, days: float = 30, late: str = "0 seconds") -> DataFrame:
    """(key, version, at) of the candidates of a stream to scan: those never scanned, in another version than the last scan's, or last scanned more than
    `days` before. Rows come in order of time, but for `late`; of one time by version. Rows without a key, version or time are nothing to scan."""
    rows = candidates.select(F.col(key), F.col(version).cast("string").alias("version"), F.col(when).cast("timestamp").alias("at")).dropna()
    schema = f"{key} {candidates.schema[key].dataType.simpleString()}, version string, at timestamp"
    return rows.withWatermark("at", late).groupBy(key).transformWithStateInPandas(_Scans(key, days), schema, "append", "EventTime")

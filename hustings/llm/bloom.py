"""Bloom filters of fixed size, built by Spark tasks and broadcast: they keep rows that can't matter out of shuffles.

A false hit costs a row; nothing is missed. The size is a parameter and doesn't grow with the data, so a filter that is too
small for its keys lets more through, and results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from hustings.llm.shingles import mixed

HASHES, BLOCK, TASKS = 3, 1 << 16, 16


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(keys ^ np.uint64(j * 0x517CC1B7 + 1)) & np.uint64(bits - 1)).astype(np.int64) for j in range(HASHES)]


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64 or uint64) the filter may hold."""
    out = np.ones(len(keys), bool)
    for at in _bits(keys.view(np.uint64), 8 * len(table)):
        out &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def build(keys: DataFrame, column: str, bits: int):
    """A broadcast variable with the filter of a long column without nulls; bits: a power of two."""
    size = min(BLOCK, bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        places = [k for k in range(0, bits // 8, size) if table[k : k + size].any()]
        yield pa.record_batch([pa.array(places, pa.int64()), pa.array([zlib.compress(table[k : k + size].tobytes(), 1) for k in places], pa.binary())], names=["at", "bits"])

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b), np.uint8) for b in pdf["bits"]]).tobytes()]})

    table = np.zeros(bits // 8, np.uint8)
    parts = keys.select(column).repartition(TASKS).mapInArrow(run, "at long, bits binary").groupBy("at").applyInPandas(union, "at long, bits binary")
    for r in parts.toLocalIterator():  # bits / 8 bytes in all
        table[r["at"] : r["at"] + size] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def only(rows: DataFrame, column: str, table) -> DataFrame:
    """The rows whose value in a long column the filter may hold; null ones go."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at)
            fine = holds(table.value, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.filter(pa.array(fine & keys.is_valid().to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(run, rows.schema)


def repeats(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (uint64) lie at places that map_repeated holds for touched more than once."""
    at = (mixed(keys) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def map_repeated(rows: DataFrame, touches: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], bits: int):
    """A broadcast bit map (bits: a power of two) of places that rows touch more than once.

    touches: the keys (uint64) of a batch of rows, and which of them count twice. Two keys at one place only let more through.
    """
    size = min(BLOCK, bits // 8)

    def marked(at: np.ndarray) -> np.ndarray:
        table = np.zeros(bits // 8, np.uint8)
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys, sure = touches(batch)
            at = (mixed(keys) & np.uint64(bits - 1)).astype(np.int64)
            place, count = np.unique(at, return_counts=True)
            now = marked(place)
            twice |= marked(place[count > 1]) | marked(at[sure]) | (once & now)
            once |= now
        for k in range(0, bits // 8, size):
            if once[k : k + size].any():
                yield pa.record_batch([pa.array([k], pa.int64()), *(pa.array([zlib.compress(x[k : k + size].tobytes(), 1)], pa.binary()) for x in (once, twice))], names=["at", "once", "twice"])

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "bits": [twice.tobytes()]})

    table = np.zeros(bits // 8, np.uint8)
    for r in rows.repartition(TASKS).mapInArrow(run, "at long, once binary, twice binary").groupBy("at").applyInPandas(union, "at long, bits binary").toLocalIterator():  # bits / 8 bytes in all
        table[r["at"] : r["at"] + size] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table)

"""Vectors as short codes: each is cut into equal parts, and each part is named by the nearest entry of its position's codebook.

Components become integers, floor(scale * x), so everything is exact. Codebooks start as the parts of the vectors with the smallest ids and are
moved in rounds: every part goes to the nearest entry (squared distance, ties to the lower index), every entry becomes the componentwise
floor of the mean of its parts; unused entries stay.

Vectors are written once as columnar NumPy blocks of at most BLOCK rows (all first components, all second ones, and so on). A round is an RDD
treeAggregate over the blocks: distances of a block accumulate dimension by dimension, np.add.at adds parts and counts into an int64 tensor
(part, entry, component), and tensors merge through a reduction tree; the driver gets one tensor of fixed size. The codebooks travel with the
tasks; they are parts x entries x width numbers whatever the data.

Rows whose vector is null or holds null or non-finite components are dropped. The width is that of most rows among the multiples of `parts` (of equally
many the smaller); rows of another length stay with a null code and error. With fewer rows than entries there are as many entries as rows. Null ids
come last; rows that share an id are ordered by their vectors; repeated rows count as often as they are there. Where squares or sums might pass 64
bits, blocks hold Python's integers instead, with the same results; an error (or sum) that does not fit a long is null. An empty table gives an empty
result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StringType, StructType

from hustings.workers import importable, temporary, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096
#: Below this, sums of two more terms still fit 64 bits.
SAFE = 1 << 61


def whole(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), int64, or Python's integers if they may be wide. scale is a power of two, so the product is exact."""
    if not wide:
        return np.floor(x.astype(np.float64) * scale).astype(np.int64)
    big = lambda v: int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale))
    return np.array([big(v) for v in x.astype(np.float64).ravel().tolist()], object).reshape(x.shape)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and squared distances, (parts, rows) each, of x: (parts, width, rows) under books: (parts, entries, width)."""
    distance = np.zeros((books.shape[0], books.shape[1], x.shape[2]), x.dtype)
    for d in range(x.shape[1]):
        step = x[:, d][:, None, :] - books[:, :, d, None]
        distance += step * step
    code = distance.argmin(1)  # the first of equals
    return code, np.take_along_axis(distance, code[:, None], 1)[:, 0]


class _Tensor:
    """Sums and counts of parts by entry; mergeable."""

    def __init__(self, sums: np.ndarray, counts: np.ndarray):
        self.sums, self.counts = sums, counts

    def add(self, x: np.ndarray, books: np.ndarray) -> _Tensor:
        code, _ = assigned(x, books)
        part = np.arange(len(books))[:, None]
        np.add.at(self.sums, (part, code), x.transpose(0, 2, 1))
        np.add.at(self.counts, (part, code), 1)
        return self

    def merge(self, other: _Tensor) -> _Tensor:
        return _Tensor(self.sums + other.sums, self.counts + other.counts)

    def moved(self, books: np.ndarray) -> np.ndarray:
        n = np.maximum(self.counts, 1)[:, :, None]
        return np.where(self.counts[:, :, None] > 0, self.sums // n, books)


class Codes:
    """What `encode` gives: rows (vec_id, label, code, error) and the final codebooks (parts, entries, width)."""

    def __init__(self, rows: DataFrame, books: np.ndarray):
        self.rows, self.books = rows, books

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integer components that a code stands for."""
        return [int(v) for p, book in enumerate(self.books) for v in book[int(code[2 * p : 2 * p + 2], 16)]]


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """(ids, labels, n, x): columnar blocks of rows (id, label, x), x of one length."""
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                listed = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column(k)])) for k in (0, 1)]
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(kind)
                yield pa.record_batch([*listed, pa.array([b.num_rows], pa.int32()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], names=["ids", "labels", "n", "x"])

    schema = StructType().add("ids", ArrayType(id_type)).add("labels", ArrayType(label_type)).add("n", IntegerType()).add("x", BinaryType())
    return rows.mapInArrow(run, schema)


def encode(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, depth: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> Codes:
    """Codebooks after all rounds, and each row's code (two hex digits a part) and error (squared distance, summed over parts)."""
    importable(table.sparkSession)
    kind = "f4" if isinstance(table.schema[vector_col].dataType.elementType, FloatType) else "f8"
    element = "float" if kind == "f4" else "double"
    fine = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{element}>").alias("x")).filter(fine)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("most"))
    chosen = sizes.filter((F.col("d") > 0) & (F.col("d") % parts == 0)).orderBy(F.desc("n"), "d").first()
    if chosen is None:
        return Codes(rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64))
    width, most = chosen.d // parts, int(chosen.most) * scale + scale + 1
    wide = max(chosen.d * 4 * most * most, chosen.n * most) >= SAFE
    same = rows.filter(F.size("x") == chosen.d)
    first = same.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = whole(np.array([r.x for r in first], kind), scale, wide).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    blocks = written(_blocks(same, kind), "vector-blocks")

    def opened(raw: bytes, n: int) -> np.ndarray:
        return whole(np.frombuffer(raw, kind).reshape(parts, width, n), scale, wide)

    packed = blocks.select("x", "n").rdd
    for _ in range(rounds):
        zero = _Tensor(np.zeros(books.shape, books.dtype), np.zeros(books.shape[:2], np.int64))
        add = lambda t, r, books=books: t.add(opened(r.x, r.n), books)
        books = packed.treeAggregate(zero, add, _Tensor.merge, depth).moved(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(max(entries, 1))])
        for batch in batches:
            for k in range(batch.num_rows):
                code, error = assigned(opened(batch.column("x")[k].as_py(), batch.column("n")[k].as_py()), books)
                names, errors = ["".join(c) for c in digits[code.T]], [str(e) for e in error.sum(0).tolist()]
                yield pa.record_batch([batch.column("ids").slice(k, 1), batch.column("labels").slice(k, 1), pa.array([names], pa.list_(pa.string())), pa.array([errors], pa.list_(pa.string()))], names=["ids", "labels", "codes", "errors"])

    schema = StructType([blocks.schema["ids"], blocks.schema["labels"]]).add("codes", ArrayType(StringType())).add("errors", ArrayType(StringType()))
    one = blocks.mapInArrow(coded, schema).select(F.inline(F.arrays_zip("ids", "labels", "codes", "errors"))).toDF("id", "label", "code", "error")
    one = one.withColumn("error", F.expr("try_cast(error as bigint)"))
    other = rows.filter(F.size("x") != chosen.d).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(one.unionByName(other), books)


def annotate(table: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    with temporary(table.sparkSession) as keep:
        found = encode(table, **options)
        rows = written(found.rows, "codes")
        total = F.when(F.count("*") == F.count("error"), F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)"))
        labels = rows.groupBy(F.col("label").alias("__label")).agg(total.alias("label_error"))
        joined = rows.join(labels, F.col("label").eqNullSafe(F.col("__label")), "left")
        return keep(written(joined.select(F.col("id").alias(options.get("id_col", "vec_id")), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")), "vector-codes"))

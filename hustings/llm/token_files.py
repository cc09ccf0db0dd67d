"""Token files: ids of documents in independent zstandard frames with a trailing seek table and per-frame checksums.

A file is: data frames; a skippable frame with the document index (compressed: ids, nulls, first token, tokens); a skippable
frame with the seek table in the public zstandard seekable layout (compressed size, size, low 32 bits of XXH64 of the
frame's content, for each frame, then the footer). Documents share a frame until it holds `frame_tokens` ids; a longer
document has frames of its own, so a reader decompresses only what a requested document lies in.

write() sorts by id (null first; equal ids by a hash of the text) over range partitions, a file for each, written under a name
that no other attempt of the task has; only files named in the returned manifest count, so lost executors and repeated
attempts leave the result whole. read() opens each file in a task of its own, checks every frame and returns documents in
their order. Null and empty texts have the end id alone; an empty table has a manifest without rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.batches import pieces
from hustings.llm.word_tokens import encoder
from hustings.workers import importable, written

#: Fixed values of the public seekable layout, and a magic number of its own for the document index.
SKIPPABLE_TABLE, SKIPPABLE_INDEX, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_TOKENS, LEVEL = 32_768, 3
MANIFEST = "part int, path string, n_docs long, n_tokens long, first_id long, last_id long"


class Writer:
    def __init__(self, sink, dtype: np.dtype, frame_tokens: int = FRAME_TOKENS):
        self.sink, self.dtype, self.limit = sink, dtype, frame_tokens * dtype.itemsize
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        self.frames: list[tuple[int, int, int]] = []
        self.held, self.size = [], 0
        self.ids, self.tokens = [], []

    def add(self, doc_id: int | None, packed: bytes) -> None:
        if self.size and self.size + len(packed) > self.limit:
            self._flush()
        self.ids.append(doc_id)
        self.tokens.append(len(packed) // self.dtype.itemsize)
        for at in range(0, len(packed), self.limit):
            part = packed[at : at + self.limit]
            self.held.append(part)
            self.size += len(part)
            if self.size >= self.limit:
                self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.held)
        if raw:
            out = self.compress(raw)
            self.sink.write(out)
            self.frames.append((len(out), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        null = np.array([i is None for i in self.ids], "u1")
        index = self.compress(struct.pack("<QB", len(self.ids), self.dtype.itemsize) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + null.tobytes() + np.array(self.tokens, "<i8").tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class Reader:
    """Reads documents by place or id; decompresses the frames that hold them and no others."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("not a token file: no seek table at its end")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.packed, self.raw, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.places = np.concatenate([[0], np.cumsum(self.packed)])
        self.starts = np.concatenate([[0], np.cumsum(self.raw)])
        magic, length = struct.unpack("<II", self._at(int(self.places[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("not a token file: no document index")
        self.decompress = zstandard.ZstdDecompressor().decompress
        index = self.decompress(self._at(int(self.places[-1]) + 8, length))
        docs, width = struct.unpack_from("<QB", index)
        self.dtype = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(index, "<i8", docs, 9)
        self.null = np.frombuffer(index, "u1", docs, 9 + 8 * docs).astype(bool)
        self.tokens = np.frombuffer(index, "<i8", docs, 9 + 9 * docs)
        self.first = np.concatenate([[0], np.cumsum(self.tokens)])
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = self.decompress(self._at(int(self.places[k]), int(self.packed[k])), max_output_size=int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged: its checksum differs")
            self._last = (k, raw)
        return self._last[1]

    def document(self, place: int) -> bytes:
        """The packed ids of the document at this place."""
        a, b = int(self.first[place]) * self.dtype.itemsize, int(self.first[place + 1]) * self.dtype.itemsize
        k, out = int(np.searchsorted(self.starts, a, "right")) - 1, []
        while a < b:
            raw, base = self.frame(k), int(self.starts[k])
            out.append(raw[a - base : b - base])
            a = base + len(raw)
            k += 1
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this id."""
        return np.flatnonzero((self.ids == doc_id) & ~self.null).tolist()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_tokens: int = FRAME_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into folder (a URI that pyarrow.fs opens on every executor); returns the manifest, ordered by part."""
    spark = docs.sparkSession
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        part, writer = TaskContext.get().partitionId(), None
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        for chunk in pieces(batches):
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(path)
                writer = Writer(sink, encode.dtype, frame_tokens)
            for doc_id, ids in zip(chunk.column(0).to_pylist(), encode.encode(chunk.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            known = [i for i in writer.ids if i is not None] or [None]
            ends = [pa.array([known[k]], pa.int64()) for k in (0, -1)]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.ids)]), pa.array([sum(writer.tokens)]), *ends], names=["part", "path", "n_docs", "n_tokens", "first_id", "last_id"])

    keys = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents: start counts the ids of all documents before; ids are packed as unsigned 32-bit integers."""
    importable(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    file = Reader(source)
                    for at in range(0, len(file.ids), 256):
                        places = range(at, min(at + 256, len(file.ids)))
                        ids = [np.frombuffer(file.document(i), file.dtype).astype("<u4").tobytes() for i in places]
                        yield pa.record_batch(
                            [
                                pa.array(file.ids[at : places.stop], pa.int64(), mask=file.null[at : places.stop]),
                                pa.array(base + file.first[at : places.stop], pa.int64()),
                                pa.array(file.tokens[at : places.stop], pa.int64()),
                                pa.array(ids, pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, no more
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, folder: str, wanted: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents with these ids: opens the files whose range holds one, decompresses the frames they lie in."""
    importable(manifest.sparkSession)
    asked = sorted(set(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, low, high in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with fs.open_input_file(path) as source:
                    file = Reader(source)
                    places = [k for i in asked if low <= i <= high for k in file.find(i)]
                    ids = [np.frombuffer(file.document(k), file.dtype).astype("<u4").tobytes() for k in places]
                    yield pa.record_batch([pa.array(file.ids[places], pa.int64()), pa.array(file.tokens[places], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    near = F.exists(F.array(*map(F.lit, asked)), lambda i: i.between(F.col("first_id"), F.col("last_id"))) if asked else F.lit(False)
    files = manifest.filter(near).select("path", "first_id", "last_id")
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "doc_id long, n_tokens long, ids binary")

"""Packing by best-fit decreasing.

Every task tokenizes its documents and packs them in blocks of about `block` tokens, without a shuffle. Overlong documents
are first cut into full windows; the rests, in decreasing length, each go to the tightest open window that holds them, found
by a segment tree whose leaves count open windows by remaining capacity. What is still loose at a block's end is closed by
cutting: the emptiest windows are taken apart to fill the gaps of the others, and the last one is cut into sequences whose
lengths are powers of two, which need no padding. So memory is bounded by a block plus one document, and padding by
`slack` tokens a window.

Null and empty texts have the end id alone. Very long texts are cut, never dropped. Ties in length keep the input's order.
Repeated rows are packed each. A null doc_id stays null. An empty table gives an empty result. Other columns don't matter.
Sequence ids are unique, not dense: the task's number in the upper bits, a running number in the lower 40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.batches import pieces
from hustings.llm.word_tokens import encoder
from hustings.workers import importable

WINDOW, BLOCK, SLACK = 2048, 4_000_000, 8
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int, int, int]  # document's place in the block, start, length


class CapacityTree:
    """A segment tree over remaining capacities 0..size-1; leaves count open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that an open window has."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i ^ 1]):
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(lengths: list[int], window: int = WINDOW, slack: int = SLACK) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of every document once."""
    full: list[list[Piece]] = []
    rests: list[Piece] = []
    for d, n in enumerate(lengths):
        cut = n - n % window
        full += [[(d, s, window)] for s in range(0, cut, window)]
        if n > cut:
            rests.append((d, cut, n - cut))
    rests.sort(key=lambda p: -p[2])
    tree, by_capacity = CapacityTree(window), [[] for _ in range(window)]
    for piece in rests:
        room = tree.tightest(piece[2])
        if room is None:
            chosen, left = [piece], window - piece[2]
        else:
            chosen = by_capacity[room].pop()
            tree.add(room, -1)
            chosen.append(piece)
            left = room - piece[2]
        by_capacity[left].append(chosen)
        tree.add(left, 1)
    done = full + [w for left in range(min(slack, window - 1) + 1) for w in by_capacity[left]]
    loose = [(left, w) for left in range(slack + 1, window) for w in by_capacity[left]]
    return done + _closed(loose, window)


def _closed(loose: list[tuple[int, list[Piece]]], window: int) -> list[list[Piece]]:
    """loose: windows with their gaps, fullest first. The emptiest are taken apart to fill the others."""
    out: list[list[Piece]] = []
    first, last = 0, len(loose) - 1
    spare: list[Piece] = []
    while first <= last:
        gap, target = loose[first]
        while gap and (spare or first < last):
            if not spare:
                spare = loose[last][1]
                last -= 1
            d, s, n = spare.pop()
            take = min(gap, n)
            target.append((d, s, take))
            if take < n:
                spare.append((d, s + take, n - take))
            gap -= take
        first += 1
        if gap == 0:
            out.append(target)
        else:
            spare = target
            break
    while spare:
        room = 1 << min(sum(n for *_, n in spare), window).bit_length() - 1
        chosen = []
        while room:
            d, s, n = spare.pop()
            take = min(room, n)
            chosen.append((d, s, take))
            if take < n:
                spare.append((d, s + take, n - take))
            room -= take
        out.append(chosen)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, block: int = BLOCK, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", remember: bool = True) -> DataFrame:
    """One row per piece, see SCHEMA; ids are packed little-endian unsigned 32-bit integers.

    remember: workers keep the words they know for their next task, which saves time and holds up to some 300 MB each.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        width, number = encode.dtype.itemsize, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal number
            sequences = best_fit_decreasing([len(x) // width for x in ids], window, slack)
            for at in range(0, len(sequences), 256):
                rows = []
                for k, sequence in enumerate(sequences[at : at + 256], at):
                    offset = 0
                    for d, s, n in sequence:
                        rows.append((names[d], s, n, np.frombuffer(ids[d], encode.dtype, n, s * width).astype("<u4").tobytes(), len(ids[d]) // width, number + k, offset))
                        offset += n
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)
            number += len(sequences)
            names.clear()
            ids.clear()

        for part in pieces(batches):
            for name, got in zip(part.column(0).to_pylist(), encode.encode(part.column(1).to_pylist()), strict=True):
                names.append(name)
                ids.append(got + end)
                held += len(ids[-1]) // width
                if held >= block:
                    yield from emit()
                    held = 0
        if names:
            yield from emit()
        if not remember:
            encoder.cache_clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.binary() if n == "ids" else pa.int64() for n in NAMES]

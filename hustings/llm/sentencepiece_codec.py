"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no vocabulary piece crosses (a space or line break starts one). Segments not seen before by the
worker are laid end to end in flat numpy arrays: symbols, and the rank of the pair that starts at each. In every round the
least rank of each segment is found by a segmented minimum, its pairs of that rank are merged in all segments at once, the arrays
are compacted, and only pairs beside a merge are ranked again; segments without a pair that merges leave. That is the
library's order exactly: best score first, then leftmost. Of overlapping pairs the left ones merge, and a merge beside which a
better pair comes up is the last of its segment in a round. So rounds follow the ranks in a segment, not its length.

Null text counts as empty. The empty text has the begin and end ids alone. Texts are encoded whole. Repeated rows are
encoded each; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.batches import pieces
from hustings.workers import importable

SPACE = "▁"
#: Segments remembered by a worker, and the longest that is remembered.
REMEMBERED, LONGEST = 400_000, 48
NONE = np.iinfo(np.int32).max
SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")


class Codec:
    """One model. Supports BPE with byte fallback, identity normalisation, a dummy prefix and no white-space removal."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not byte[i]]
        if sum(byte) != 256 or sp.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}" or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("not a BPE model with byte fallback and identity normalisation")
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", text[i], re.S) for i in normal):
            raise ValueError("a piece crosses a segment's start")
        self.byte_ids = [0] * 256
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(text[i][3:5], 16)] = i
        self._tables(text, normal, [sp.get_score(i) for i in range(n)], n)
        self._decoding(text, special, byte, sp.unk_id(), n)
        self.known: dict[str, bytes] = {}

    def _tables(self, text: list[str], normal: list[int], score: list[float], n: int) -> None:
        symbol = {text[i]: i for i in normal}
        chars = sorted({c for s in symbol for c in s} - symbol.keys())  # these have no id, yet a pair of them may
        self.real, self.symbols = n, n + len(chars)
        symbol |= {c: n + k for k, c in enumerate(chars)}
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        rank = {s: k for k, s in enumerate(sorted({score[i] for i in normal}, reverse=True))}
        pairs = sorted((symbol[s[:k]] * self.symbols + symbol[s[k:]], rank[score[i]], i) for s, i in ((text[i], i) for i in normal) for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol)
        self.keys = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([p[1] for p in pairs] + [NONE], np.int32)
        self.merged = np.array([p[2] for p in pairs] + [-1], np.int32)

    def _decoding(self, text: list[str], special: list[bool], byte: list[bool], unknown: int, n: int) -> None:
        surface = [b"" if special[i] else bytes([int(text[i][3:5], 16)]) if byte[i] else text[i].replace(SPACE, " ").encode() for i in range(n)]
        surface[unknown] = " ⁇ ".encode()
        self.length = np.array([len(s) for s in surface], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.spaced = np.array([not special[i] and not byte[i] and text[i][:1] == SPACE for i in range(n)])
        self.silent = np.array(special)
        self.silent[unknown] = False

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.symbols + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols of many segments, end to end, and the segment of each, ascending; both after all merges."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last = np.empty(len(symbols), bool)
        last[:-1], last[-1:] = segment[1:] != segment[:-1], True
        rank, into = self._rank(symbols, np.append(symbols[1:], -1))
        rank[last] = NONE
        while len(symbols):
            start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(symbols)))
            live = np.repeat(least != NONE, size)
            if not live.all():
                done.append((symbols[~live], segment[~live]))
                symbols, segment, rank, into = symbols[live], segment[live], rank[live], into[live]
                size, least = size[least != NONE], least[least != NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = self._at_once(hit, symbols, segment, rank, into)
            symbols[hit] = into[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = hit - np.arange(len(hit))  # where the merged symbols are after compaction: one left out before each
            symbols, segment, rank, into = symbols[keep], segment[keep], rank[keep], into[keep]
            again = np.concatenate([place, place - 1])
            again = again[again >= 0]
            end = (again + 1 >= len(symbols)) | (segment[np.minimum(again + 1, len(symbols) - 1)] != segment[again])
            r, m = self._rank(symbols[again], symbols[np.minimum(again + 1, len(symbols) - 1)])
            rank[again], into[again] = np.where(end, NONE, r), m
        if not done:
            return symbols, segment
        symbols, segment = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _at_once(self, hit: np.ndarray, symbols: np.ndarray, segment: np.ndarray, rank: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Of the places of each segment's best pairs those that the library merges one after another, with no other pair between."""
        nth = np.arange(len(hit))
        run = np.append(True, hit[1:] != hit[:-1] + 1)  # pairs of one run overlap: every second merges
        hit = hit[(nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0]
        first = np.append(True, segment[hit[1:]] != segment[hit[:-1]])
        if first.all():
            return hit
        k = np.flatnonzero(~first | np.append(~first[1:], False))
        h, end = hit[k], len(symbols) - 1
        beside = ~first[k] & (hit[k - 1] + 2 == h)  # what lies to the left has just been merged
        left = np.where(beside, into[hit[k - 1]], symbols[np.maximum(h - 1, 0)])
        right = np.minimum(h + 2, end)
        better = (h > 0) & (segment[h - 1] == segment[h]) & (self._rank(left, into[h])[0] < rank[h])
        better |= (h + 2 <= end) & (segment[right] == segment[h]) & (self._rank(into[h], symbols[right])[0] < rank[h])
        found = np.zeros(len(hit), np.int64)
        found[k] = better
        before = np.cumsum(found) - found
        return hit[before == before[np.flatnonzero(first)][np.cumsum(first) - 1]]

    def _spelt(self, symbols: list[int], chars: str, at: int) -> list[int]:
        """Ids of symbols of which some have none: those are characters, spelt in bytes. symbols cover chars from `at` on."""
        out = []
        for s in symbols:
            if 0 <= s < self.real:
                out.append(s)
                at += self.width[s]
            else:
                out += [self.byte_ids[b] for b in chars[at].encode()]
                at += 1
        return out

    def _learn(self, missing: list[str]) -> None:
        full = [w if w[:1] == "\n" else SPACE + w for w in missing]
        sizes = np.array([len(w) for w in full])
        points = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32)
        symbols, segment = self._rounds(self.of_char[points], np.repeat(np.arange(len(full)), sizes))
        ends = np.searchsorted(segment, np.arange(len(full)), "right")
        odd = np.zeros(len(full), bool)
        odd[segment[(symbols < 0) | (symbols >= self.real)]] = True
        packed, a = symbols.astype("<u4").tobytes(), 0
        for k, (b, x) in enumerate(zip(ends.tolist(), odd.tolist(), strict=True)):
            self.known[missing[k]] = np.array(self._spelt(symbols[a:b].tolist(), full[k], 0), "<u4").tobytes() if x else packed[4 * a : 4 * b]
            a = b

    @property
    def width(self) -> list[int]:
        """Characters of each piece."""
        if not hasattr(self, "_width"):
            self._width = [len(bytes(self.surface[a : a + n]).decode(errors="replace")) for a, n in zip(self.first.tolist(), self.length.tolist(), strict=True)]
        return self._width

    @staticmethod
    def segments(text: str) -> list[str]:
        """Without the one space sign that all have in front, save those that start with a line break."""
        if "  " in text or text[:1] == " " or SPACE in text:
            return [s if s[0] == "\n" else s[1:] for s in SEGMENTS.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text, without begin and end ids."""
        split = [self.segments(t) if t else [] for t in texts]
        own = set().union(*split) if split else set()
        missing = own - self.known.keys()
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, missing = {}, own
        if missing:
            self._learn(list(missing))
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for s in missing:
            if len(s) > LONGEST:
                del self.known[s]
        return out

    def decode(self, packed: bytes) -> str:
        """What the library's decode() gives for these ids."""
        ids = np.frombuffer(packed, "<u4")
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        length = self.length[ids]
        total = int(length.sum())
        at = np.repeat(self.first[ids] - (np.cumsum(length) - length), length) + np.arange(total)
        raw = self.surface[at].tobytes()
        if self.spaced[ids[0]]:
            raw = raw[1:]
        return raw.decode(errors="each")


codecs.register_error("each", lambda e: ("�", e.start + 1))


@lru_cache(maxsize=4)
def codec(model: str) -> Codec:
    """One for each worker process and file."""
    return Codec(model)


def encode_decode(docs: DataFrame, model: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): packed little-endian unsigned 32-bit ids of each whole text, and what they decode to."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        head = np.array([own.bos] * begin, "<u4").tobytes()
        tail = np.array([own.eos] * end, "<u4").tobytes()
        for part in pieces(batches):
            ids = [head + x + tail for x in own.encode(part.column(1).to_pylist())]
            yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")

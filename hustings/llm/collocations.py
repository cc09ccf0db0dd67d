r"""Collocations: phrases of words that stand together more often than their parts would, by language.

Texts, A-Z lower-cased, are cut at [.,;:!?\x0A-\x0D] into pieces and those into words [^\x20\x09]+. f(phrase) counts all contiguous
occurrences within pieces, overlaps included.

1. A task numbers the words of its texts and writes shards of at most about `shard` words of one language: the words' numbers in
   order, a gap between pieces, and the shard's vocabulary with counts. The counts are summed: f of words and n.
2. Each shard gets back which of its words are frequent (by a join on the word, so nothing of vocabulary size is broadcast) and holds a
   position bitmap for each of them, compressed: only blocks of BITS positions with a bit set are kept. Phrases grow depth-first, a bundle
   of prefixes at a time: the prefix's bitmap is shifted by one position (gaps keep pieces apart), ANDed with the bitmaps of words, and what is left
   is counted by popcount. Popcounts are summed over shards.
3. That is done once for each length: phrases of k words grow only from those of k - 1 that are frequent over all shards and whose last
   pair is, which is known to each shard from the shuffle that summed them.

A phrase is a candidate with f >= `least`; all its parts are then as frequent. Its score is the least of floor(10^6 a^2 / (l r)) over its
cuts (l and r being f of the two parts), in 38-digit integers. Candidates within a longer candidate that has `share` percent of their
occurrences are dropped. Ranks are by score, a (both descending) and phrase; phrases of one language meet in salted parts first.

A null text is empty, a null lang is `und`. Repeated rows count as often as they are there; ids don't matter. A text of more than
`shard` words is a shard of its own. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.batches import pieces
from hustings.workers import importable, temporary, written

LEAST, LONGEST, SHARE, TOP, SHARD = 10, 3, 50, 2000, 2_000_000
#: Full shards' worth of words that a task holds at most.
MOST_HELD = 4
#: Positions of a bitmap's block; entries of prefixes that are extended at once; parts of a language that are ranked by themselves first.
BITS, BUNDLE, SALTS = 16, 1 << 16, 32
#: A-Z become a-z and what ends a piece becomes a line feed, byte by byte.
BYTES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKENS = re.compile(rb"[^ \t\n]+|\n")

SHARDS = "shard long, lang string, words array<string>, counts array<long>, sequence binary"
GROWN = "shard long, parent long, word long, n long"


class _Shard:
    """The words of texts of one language, numbered from 1 in order of appearance; 0 is a gap."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {b"\n": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        known = self.known
        ids = [known.setdefault(w, len(known)) for w in TOKENS.findall(text.translate(BYTES))]
        self.parts.append(np.array([*ids, 0], np.int32))
        self.size += len(ids) + 1
        return len(ids) + 1

    def row(self, number: int, lang: str) -> dict:
        sequence = np.concatenate(self.parts)
        counts = np.bincount(sequence, minlength=len(self.known))[1:]
        return {"shard": number, "lang": lang, "words": list(self.known)[1:], "counts": counts, "sequence": sequence.astype("<i4").tobytes()}


def _shards(docs: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """One row per shard: shard, lang, words, counts, sequence."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("sequence", pa.binary())])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        words = pa.ListArray.from_arrays(np.cumsum([0, *(len(r["words"]) for r in rows)]).astype("i4"), pa.array([w for r in rows for w in r["words"]], pa.binary()).cast(pa.string()))
        counts = pa.ListArray.from_arrays(words.offsets, pa.array(np.concatenate([r["counts"] for r in rows]).astype("i8")))
        plain = [pa.array([r[k] for r in rows], schema.field(k).type) for k in ("shard", "lang", "sequence")]
        return pa.record_batch([plain[0], plain[1], words, counts, plain[2]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, _Shard] = {}
        total = 0
        for chunk in pieces(batches):
            for lang, text in zip(chunk.column(0).to_pylist(), chunk.column(1).cast(pa.binary()).to_pylist(), strict=True):
                name = "und" if lang is None else lang
                own = held.setdefault(name, _Shard())
                added = own.add(text or b"")
                total += added
                # a language's shard goes when it is full; the largest goes when all that is held is too much
                while held and (own.size >= most or total >= MOST_HELD * most):
                    full = name if own.size >= most else max(held, key=lambda x: held[x].size)
                    total -= held[full].size
                    yield batch([held.pop(full).row(number, full)])
                    number += 1
                    if full == name:
                        break
        for name, own in held.items():
            yield batch([own.row(number, name)])
            number += 1

    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SHARDS)


class Bitmaps:
    """Position bitmaps of the words of a sequence (numbers from 1; 0 is a gap), by word and by block; only blocks with a bit set are kept."""

    def __init__(self, sequence: np.ndarray):
        at = np.flatnonzero(sequence)
        block, mask = (at // BITS).astype(np.int32), np.left_shift(1, at % BITS).astype(np.uint32)
        order = np.argsort(sequence[at], kind="stable")
        word, block, mask = sequence[at][order], block[order], mask[order]
        new = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.word, self.block = word[new], block[new]
        self.mask = np.bitwise_or.reduceat(mask, new) if len(new) else mask
        self.blocks = len(sequence) // BITS + 2  # a bit may be shifted into the block after the last
        by_block = np.argsort(self.block, kind="stable")
        self.in_block = np.searchsorted(self.block[by_block], np.arange(self.blocks + 1))
        self.block_word, self.block_mask = self.word[by_block], self.mask[by_block]

    def extended(self, prefix: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(prefix, word, block, mask) of all prefixes with each word that follows somewhere: shifted bitmaps AND bitmaps of words, where not empty."""
        shifted = mask << np.uint32(1)
        here, over = shifted & np.uint32((1 << BITS) - 1), shifted >> np.uint32(BITS)
        stay, carried = np.flatnonzero(here), np.flatnonzero(over)
        prefix = np.concatenate([prefix[stay], prefix[carried]])
        block = np.concatenate([block[stay], block[carried] + 1])
        mask = np.concatenate([here[stay], over[carried]])
        first, many = self.in_block[block], self.in_block[block + 1] - self.in_block[block]
        left = np.repeat(np.arange(len(block)), many)
        right = np.arange(len(left)) + np.repeat(first - (np.cumsum(many) - many), many)
        both = mask[left] & self.block_mask[right]
        some = np.flatnonzero(both)
        left = left[some]
        return prefix[left], self.block_word[right[some]], block[left], both[some]


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ascending `keys` that hold each wanted key; -1 where none does."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with sums."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of `wanted` in ids, which are in any order; all are there."""
    order = np.argsort(ids)
    return order[np.searchsorted(ids, wanted, sorter=order)].astype(np.int64)


def grow(maps: Bitmaps, words: int, levels: list[np.ndarray], bundle: int = BUNDLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, word, popcount) of phrases one word longer than the last level, depth-first through the levels.

    levels[j] lists the phrases of j + 2 words to grow through: ascending keys parent * words + word, parent being a word for pairs and a place in the
    level before for longer ones. A longer phrase's last pair must be in levels[0].
    """
    out = [(np.zeros(0, np.int64),) * 2]

    def extend(prefix: np.ndarray, last: np.ndarray, block: np.ndarray, mask: np.ndarray, depth: int) -> None:  # last: last words by prefix
        for at in range(0, len(prefix), bundle):
            s = slice(at, at + bundle)
            p, w, b, m = maps.extended(prefix[s], block[s], mask[s])
            if depth:
                fine = _among(levels[0], last[p] * words + w) >= 0
                p, w, b, m = p[fine], w[fine], b[fine], m[fine]
            if depth == len(levels):
                out.append(_summed(p.astype(np.int64) * words + w, np.bitwise_count(m).astype(np.int64)))
                continue
            place = _among(levels[depth], p.astype(np.int64) * words + w)
            on = np.flatnonzero(place >= 0)
            extend(place[on], levels[depth] % words, b[on], m[on], depth + 1)

    extend(maps.word, np.zeros(0, np.int64), maps.block, maps.mask, 0)
    keys, n = _summed(*(np.concatenate(x) for x in zip(*out, strict=True)))
    return keys // words, keys % words, n


def _grown(shards: DataFrame, lists: DataFrame, depth: int) -> DataFrame:
    """(shard, parent, word, n): popcounts of phrases of depth + 1 words, by shard.

    lists: (shard, level, parent, word, id): frequent phrases that occur in a shard, by length; of words, `word` is the number within the shard.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {k: right.column(k).to_numpy() for k in ("level", "parent", "word", "id")}
        of = lambda level: {k: v[kinds["level"] == level] for k, v in kinds.items()}
        none = pa.table({k: np.zeros(0, np.int64) for k in ("shard", "parent", "word", "n")})
        vocabulary = of(1)
        if left.num_rows == 0 or not len(vocabulary["id"]):
            return none
        sequence = np.frombuffer(left.column("sequence")[0].as_py(), "<i4")
        order = np.argsort(vocabulary["id"])
        ids = [np.concatenate([[-1], vocabulary["id"][order]])]  # by number from 1, ascending
        words = len(ids[0])
        dense = np.zeros(int(sequence.max()) + 1, np.int32)
        dense[vocabulary["word"][order]] = np.arange(1, words)
        levels = []
        for level in range(2, depth + 1):
            found = of(level)
            keys = _places(ids[-1], found["parent"]) * words + _places(ids[0], found["word"])
            order = np.argsort(keys)
            levels.append(keys[order])
            ids.append(found["id"][order])
        parent, word, n = grow(Bitmaps(dense[sequence]), words, levels)
        return pa.table({"shard": np.full(len(n), left.column("shard")[0].as_py(), np.int64), "parent": ids[-1][parent], "word": ids[0][word], "n": n})

    return shards.select("shard", "sequence").groupBy("shard").cogroup(lists.groupBy("shard")).applyInArrow(run, GROWN)


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to `longest` words with f >= least, and (lang, n) of all languages with words."""
    importable(docs.sparkSession)
    shards = written(_shards(docs, text_col, lang_col, shard), "shards")
    own = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("p", "z"))
    own = own.select("shard", "lang", (F.col("p") + 1).cast("long").alias("number"), F.col("z.words").alias("phrase"), F.col("z.counts").alias("n"))
    total = written(own.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = own.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = written(words.withColumn("id", F.monotonically_increasing_id()), "words")  # ids are fixed once written
    lists = own.join(words, ["lang", "phrase"]).select("shard", F.lit(1).alias("level"), F.lit(-1).cast("long").alias("parent"), F.col("number").alias("word"), "id")
    lists = written(lists, "lists")
    spelt, found = words.select(F.col("id").alias("word"), F.col("phrase").alias("last")), words.withColumn("size", F.lit(1))
    every = found.select("lang", "phrase", "size", "f")
    phrase = Window.partitionBy("parent", "word")
    for size in range(2, longest + 1):
        grown = written(_grown(shards, lists, size - 1), "grown")
        if size < longest:  # one shuffle brings a phrase's shards together: its count, a number for it, and the shards that grow it further
            seen = grown.withColumn("row", F.monotonically_increasing_id()).withColumns({"f": F.sum("n").over(phrase), "id": F.min("row").over(phrase)})
            seen = written(seen.filter(F.col("f") >= least), "phrases")
            lists = lists.unionByName(seen.select("shard", F.lit(size).alias("level"), "parent", "word", "id"))
            frequent = seen.filter("row = id").select("parent", "word", "f", "id")
        else:
            frequent = grown.groupBy("parent", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        above = found.select(F.col("id").alias("parent"), "lang", F.col("phrase").alias("first"))
        found = frequent.join(above, "parent").join(spelt, "word").drop("parent", "word").withColumns({"phrase": F.concat_ws(" ", "first", "last"), "size": F.lit(size)})
        found = written(found.drop("first", "last"), "found")
        every = every.unionByName(found.select("lang", "phrase", "size", "f"))
    return every, total


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score."""
    with temporary(docs.sparkSession) as keep:
        every, total = counted(docs, least, longest, text_col, lang_col, shard)
        candidates = every.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
        parts = F.split("phrase", " ")
        piece = lambda start, n: F.array_join(F.slice(parts, start, n), " ")

        cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cut = cut.withColumns({"first": piece(F.lit(1), F.col("k")), "rest": piece(F.col("k") + 1, F.col("size") - F.col("k"))})
        cut = cut.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        cut = cut.join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        whole = lambda c: f"cast({c} as decimal(19, 0))"
        cut = cut.withColumn("score", F.expr(f"({whole('a')} * {whole('a')} * 1000000) div ({whole('l')} * {whole('r')})"))
        scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.*")

        inner = candidates.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))).select("lang", piece(F.col("at"), F.col("m")).alias("phrase"), "a")
        longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        left = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))

        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        return keep(written(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))

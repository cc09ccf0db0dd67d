"""Substring dedup: words covered by a `window` of words that also starts in a document with a smaller id are removed.

1. Anchors. Every window of `window` words has a least hash among its grams of GRAM words; the grams that are least in some
   window are a text's anchors. Equal windows have equal anchors at equal places. One shuffle of (anchor, id) finds the anchors
   of more than one id; a Bloom filter of fixed size holds them for the next pass (a false hit costs a row, nothing is missed).
2. Contexts. Around each such anchor lie the words of the windows it is the least of. A row for each document and distinct
   context of it is written, with the words in the first such row of a task only. Aggregated, there is one row for each distinct
   context, with the least and the largest id that have it.
3. Distinct contexts go to the shard of their anchor, become an FM-index there (fm_index), separated, and are streamed through it
   by backward search; each place that matches `window` words learns the least id of all documents that have those words.
   Contexts are told apart by 128 bits of their spelling, and word numbers are given to whole words, so matches are exact; hashes of
   words only choose anchors. Where very many documents share a passage, the anchors near its
   edges have a context of its own in each of them. So the contexts of anchors with more than CROWD of them are first trimmed to
   windows that more than one document may have (by a bit map of fixed size; a false hit costs a row) and aggregated again, which
   leaves few. What was found is joined back to the rows of documents, which are told apart by a hash of the text if they share an id.
4. Documents without an interval (again by a Bloom filter of fixed size) are finished where they are read; the others meet
   their intervals by a shuffle on the id.

Words are [^\\x20\\x09-\\x0D]+; what stays is joined by one space. Null and empty texts have no words. Rows of a null id are left
alone and remove nothing. Rows with the same id don't remove from each other. Texts are used whole. An empty table gives an
empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm import bloom
from hustings.llm.batches import pieces
from hustings.llm.fm_index import FMIndex
from hustings.llm.shingles import ODD, hashed_words, mixed, spelling, words_of
from hustings.workers import importable, temporary, written

WINDOW, GRAM = 50, 8
#: Bits of the filters and of the bit map (8 MB, 4 MB, 4 MB), distinct contexts of an anchor that are not trimmed at most.
ANCHOR_BITS, ID_BITS, WINDOW_BITS, CROWD = 1 << 26, 1 << 25, 1 << 25, 128
#: Words of a shard's index at least.
SHARD_WORDS = 400_000


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w values in a row."""
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def _hashed(x: np.ndarray, k: int, by: np.uint64 = ODD) -> np.ndarray:
    out = np.zeros(len(x) - k + 1, np.uint64)
    for j in range(k):
        out = out * by + x[j : len(x) - k + 1 + j]
    return mixed(out) | np.uint64(1)


def anchors(words: np.ndarray, sizes: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: places of anchors, their hashes, and how many windows to the left (first, last) each is the least of.

    A window is counted for its leftmost least gram: first..last are the offsets of the anchor in the windows it stands for.
    """
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < window:
        return none, none.astype(np.uint64), none, none
    span = window - gram + 1
    g = _hashed(words, gram)
    ends = np.repeat(np.cumsum(sizes), sizes)
    start = np.arange(n - window + 1)
    real = start + window <= ends[: len(start)]
    least = _slide(g, span, np.minimum)[: len(start)]
    # leftmost least gram of each window: values and places packed would not fit 64 bits, so compare step by step
    at = np.full(len(start), -1)
    candidates = np.flatnonzero(_slide(np.concatenate([np.zeros(span - 1, np.uint64), np.where(real, least, 0), np.zeros(span - 1, np.uint64)]), span, np.maximum)[: len(g)] == g)
    by_value = candidates[np.searchsorted(candidates, start)[real].clip(max=len(candidates) - 1)] if len(candidates) else none
    at_real = by_value
    wrong = g[at_real] != least[real]
    place = np.searchsorted(candidates, at_real)
    while wrong.any():
        place = np.where(wrong, place + 1, place)
        at_real = candidates[place.clip(max=len(candidates) - 1)]
        wrong = g[at_real] != least[real]
    at[real] = at_real
    begin = start[real]
    new = np.flatnonzero(np.append(True, at_real[1:] != at_real[:-1])) if len(at_real) else none
    where = at_real[new]
    last = where - begin[new]
    first = where - begin[np.append(new[1:], len(begin)) - 1] if len(new) else none
    return where, g[where], first, last


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes end to end, words of each row, ids (rows of a null id have no words)."""
    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
    words, sizes = hashed_words(t if i is not None else None for i, t in zip(ids, texts, strict=True))
    return words, sizes, np.array([i or 0 for i in ids], np.int64)


def _anchored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, sizes, ids = _texts(part)
            place, value, _, _ = anchors(words, sizes, window)
            doc = ids[np.searchsorted(np.cumsum(sizes), place, "right")]
            both = np.unique(np.stack([value.view(np.int64), doc]), axis=1)
            yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["anchor", "doc"])

    return run


CONTEXT = "anchor long, one long, two long, doc long, mark long, left int, at array<int>, words binary"
COLUMNS = (*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int32()), pa.binary())


def _contexts(window: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, int]] = set()
        for part in pieces(batches):
            words, sizes, ids = _texts(part)
            marks = part.column(2).to_pylist()
            place, value, first, last = anchors(words, sizes, window)
            keep = bloom.holds(known.value, value)
            place, value, first, last = place[keep], value[keep], first[keep], last[keep]
            if not len(place):
                continue
            ends = np.cumsum(sizes)
            base = ends - sizes
            row = np.searchsorted(ends, place, "right")
            order = np.lexsort((place, value, row))
            place, row, value, left = (x[order] for x in (place, row, value, last))
            begin = place - base[row] - left  # words of all windows that the anchor stands for, within the text
            end = (place - base[row] - first[order] + window).tolist()
            out: list[tuple] = []
            edge = [*np.flatnonzero(np.diff(row, prepend=-1)).tolist(), len(row)]
            for x, y in pairwise(edge):
                q = int(row[x])
                text = b" ".join(words_of(part.column(1)[q].as_py()))
                gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                starts, stops = np.concatenate([[0], gaps + 1]).tolist(), [*gaps.tolist(), len(text)]
                same: dict[tuple, tuple[list[int], bytes]] = {}  # places by context: by what the words are, not by hashes of words
                for v, a, lead, e, at in zip(value[x:y].view(np.int64).tolist(), begin[x:y].tolist(), left[x:y].tolist(), end[x:y], (place[x:y] - base[q]).tolist(), strict=True):
                    spelt = text[starts[a] : stops[e - 1]]
                    same.setdefault((v, *spelling(spelt, lead), lead), ([], spelt))[0].append(at)
                for (v, one, two, lead), (at, spelt) in same.items():
                    new = (v, one, two) not in sent
                    if new:
                        if len(sent) >= 1_000_000:
                            sent.clear()
                        sent.add((v, one, two))
                    out.append((v, one, two, int(ids[q]), marks[q], lead, at, spelt if new else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), COLUMNS, strict=True)], names=[f.split()[0] for f in CONTEXT.split(", ")])

    return run


TRIMMED = "anchor long, one long, two long, start int, t1 long, t2 long, oldest long, newest long, words binary"


def _starts(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of contexts (words in the last column): hash, row, first word."""
    words, sizes = hashed_words(t.decode(errors="surrogatepass") for t in part.column(5).to_pylist())
    ends = np.cumsum(sizes)
    value = _hashed(words, window)
    at = np.arange(len(value))
    row = np.searchsorted(ends, at, "right")
    real = at + window <= ends[row]
    at, row = at[real], row[real]
    return value[at], row, at - (ends - sizes)[row]


def _touches(window: int):
    """What a context's windows add to the bit map: those of several ids count twice."""

    def run(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        value, row, _ = _starts(part, window)
        return value, (part.column(3).to_numpy() < part.column(4).to_numpy())[row]

    return run


def _trimmed(window: int, often):
    """Contexts (anchor, one, two, oldest, newest, words) cut down to stretches of windows that the bit map holds for repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 5):
            value, row, start = _starts(part, window)
            keep = bloom.repeats(often.value, value)
            row, start = row[keep], start[keep]
            if not len(row):
                continue
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
            last = np.append(first[1:], len(row)) - 1
            spelt = {r: part.column(5)[r].as_py().split(b" ") for r in np.unique(row).tolist()}
            texts = [b" ".join(spelt[r][a : b + window]) for r, a, b in zip(row[first].tolist(), start[first].tolist(), start[last].tolist(), strict=True)]
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<i8").reshape(-1, 2).T.copy()
            anchor, one, two, oldest, newest = (part.column(k).to_numpy()[row[first]] for k in range(5))
            columns = [anchor, one, two, start[first].astype(np.int32), *digests, oldest, newest]
            yield pa.record_batch([*map(pa.array, columns), pa.array(texts, pa.binary())], names=[f.split()[0] for f in TRIMMED.split(", ")])

    return run


HIT = "anchor long, one long, two long, first int, last int, who long"


def _hits(window: int, oldest: np.ndarray, newest: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of distinct contexts: row, first and last start (in words) of neighbouring windows, the least id with them; only if that isn't newest's own."""
    numbers: dict[bytes, int] = {}
    flat = np.array([n for t in texts for n in (*(numbers.setdefault(w, len(numbers) + 1) for w in t.split(b" ")), 0)], np.int64)
    ends = np.flatnonzero(flat == 0)
    begins = np.append(0, ends[:-1] + 1)
    index = FMIndex(flat, window)
    least = index.least_by_group(np.repeat(oldest, ends - begins + 1))
    length, group = index.matches(flat, ends, int((ends - begins).max()))
    hit = np.flatnonzero((length >= window) & (group >= 0))
    of = np.searchsorted(ends, hit)
    who = least[group[hit]]
    hit, of, who = (x[who < newest[of]] for x in (hit, of, who))
    start = hit - begins[of]
    fresh = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1) | (who[1:] != who[:-1]))[: len(hit)])
    last = np.append(fresh[1:], len(hit)) - 1 if len(fresh) else fresh
    return of[fresh], start[fresh], start[last], who[fresh]


def _searched(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def shard() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            row, first, last, who = _hits(window, t.column("oldest").to_numpy(), t.column("newest").to_numpy(), t.column("words").to_pylist())
            keys = [pa.array(t.column(k).to_numpy()[row]) for k in ("anchor", "one", "two")]
            return pa.record_batch([*keys, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(who)], names=[f.split()[0] for f in HIT.split(", ")])

        for table in _run_tables(batches):
            a, oldest, newest = (table.column(k).to_numpy() for k in ("anchor", "oldest", "newest"))
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            shared = np.repeat(np.minimum.reduceat(oldest, starts) != np.maximum.reduceat(newest, starts), np.diff(np.append(starts, len(a))))
            table = table.filter(pa.array(shared))
            if not table.num_rows:
                continue
            held.append(table)
            size += int(pa.compute.sum(pa.compute.binary_length(table.column("words"))).as_py()) // 6
            if size >= SHARD_WORDS:
                yield shard()
                held, size = [], 0
        if held:
            yield shard()

    return run


def _run_tables(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole runs of an anchor, of rows sorted by it."""
    import pyarrow.compute  # noqa: F401

    held: list[pa.RecordBatch] = []
    last = None
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            batch = whole.slice(k, rows)
            a = batch.column(0).to_numpy()
            if held and a[0] != last:
                yield pa.Table.from_batches(held)
                held = []
            change = np.flatnonzero(a != a[-1])
            if len(change):
                cut = int(change[-1]) + 1
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
            last = a[-1]
    if held:
        yield pa.Table.from_batches(held)


FINISHED = "doc_id long, kept string, n_words long, n_removed long"


def _finished(rows: list[tuple[int | None, str | None, bytes | None]]) -> pa.RecordBatch:
    out = []
    for doc, text, cut in rows:
        words = (text or "").encode(errors="surrogatepass").split()
        n = len(words)
        if cut:
            stay = np.ones(n + 1, np.int64)
            spans = np.frombuffer(cut, np.int32).reshape(-1, 2)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, spans[:, 0], 1)
            np.add.at(edge, spans[:, 1], -1)
            stay = np.cumsum(edge)[:n] == 0
            words = [words[k] for k in np.flatnonzero(stay)]
        out.append((doc, b" ".join(words).decode(errors="surrogatepass"), n, n - len(words)))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "kept", "n_words", "n_removed"])


def _untouched(touched):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            ids = part.column(0).to_pylist()
            held = bloom.holds(touched.value, np.array([i or 0 for i in ids], np.int64))
            rows = [(i, t, None) for i, t, h in zip(ids, part.column(1).to_pylist(), held.tolist(), strict=True) if i is None or not h]
            if rows:
                yield _finished(rows)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        spans = [None if s is None else np.array([(x["start"], x["stop"]) for x in s], np.int32).tobytes() for s in part.column(2).to_pylist()]
        yield _finished(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), spans, strict=True)))


def _cuts(rows: DataFrame, window: int) -> DataFrame:
    """doc, mark, start, stop: words to remove, from start on and before stop."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.mapInArrow(_anchored(window), "anchor long, doc long").groupBy("anchor").agg(F.min("doc").alias("oldest"), F.max("doc").alias("newest"))
    known = bloom.build(written(seen.filter("oldest < newest").select("anchor"), "anchors"), "anchor", ANCHOR_BITS)
    contexts = written(rows.mapInArrow(_contexts(window, known), CONTEXT), "contexts")
    merged = [F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.first("words", ignorenulls=True).alias("words")]
    key = ["anchor", "one", "two"]
    distinct = written(contexts.withColumns({"oldest": F.col("doc"), "newest": F.col("doc")}).groupBy(*key).agg(*merged), "distinct-contexts")
    crowded = written(distinct.groupBy("anchor").count().filter(F.col("count") > CROWD).select("anchor"), "crowded")
    busy = distinct.join(crowded, "anchor", "left_semi").select(*key, "oldest", "newest", "words")
    trimmed = written(busy.mapInArrow(_trimmed(window, bloom.map_repeated(busy, _touches(window), WINDOW_BITS)), TRIMMED), "trimmed")
    alike = trimmed.groupBy("anchor", "t1", "t2").agg(*merged).select("anchor", F.col("t1").alias("one"), F.col("t2").alias("two"), "oldest", "newest", "words")
    shards = distinct.join(crowded, "anchor", "left_anti").unionByName(alike).repartition(parts, "anchor").sortWithinPartitions(*key)
    hits = written(shards.mapInArrow(_searched(window), HIT), "hits")
    back = trimmed.join(hits.withColumnsRenamed({"one": "t1", "two": "t2"}), ["anchor", "t1", "t2"]).filter("who < newest")
    back = back.select(*key, (F.col("first") + F.col("start")).alias("first"), (F.col("last") + F.col("start")).alias("last"), "who")
    found = contexts.select(*key, "doc", "mark", "left", "at").join(hits.unionByName(back), key).filter("who < doc")
    placed = found.select("doc", "mark", F.explode(F.transform("at", lambda p: p - F.col("left"))).alias("begin"), "first", "last")
    return placed.select("doc", "mark", (F.col("begin") + F.col("first")).alias("start"), (F.col("begin") + F.col("last") + window).alias("stop")).distinct()


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, kept (text), n_words, n_removed."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    with temporary(spark) as keep:
        intervals = keep(written(_cuts(rows, window), "intervals"))
    touched = bloom.build(intervals.select("doc").distinct(), "doc", ID_BITS)
    spans = intervals.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    met = bloom.only(rows, "doc_id", touched).join(spans.withColumnRenamed("doc", "doc_id"), ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_untouched(touched), FINISHED).unionByName(met.mapInArrow(_cut, FINISHED))

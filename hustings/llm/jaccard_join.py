"""N-gram Jaccard join by rare-first prefix filtering, with length, positional and suffix filters.

1. One pass makes each document's shingle set (as 64-bit hashes), its size and a 128-bit digest of its lower-cased words (equal word
   sequences are one node), and two sketches over all
   documents: `buckets` counters of shingles, and a bit map of places that one document alone has touched. A shingle at such a
   place is in no other document: it is the rarest there is. Both sketches have a fixed size, so they are broadcast; where the
   data outgrow them, fewer shingles are known to be rare, and results stay the same. What tasks have counted is joined FAN tasks
   at a time, level by level.
2. A set's shingles are ordered by rarity: those of no other document, then by their bucket's count, then hash. The order is the
   same in all sets, common ones last. Two sets with Jaccard similarity >= t share a shingle among the first
   n - ceil(t * n) + 1 of each. Of those prefixes the shingles that other documents may have are dealt out by shingle;
   shingles of a single node end there. Shingles that the sketch holds for very common are dealt out in parts, by node.
   (Rows of a document that an earlier row of the task equals aren't dealt out again.)
3. Nodes that share a prefix shingle are candidates if sizes and positions allow the overlap (length and positional filters).
   Short runs give all their pairs. A long run is first tried along a chain in an order of its own by hash, CHAIN pairs a row.
4. Candidates are verified once a pair: each partner's text goes to its leader's part, at most `block` partners a part; before
   the exact intersection of the sets, the suffix filter bounds the overlap: a set's parity is, for each of CLASSES classes, whether
   it has an odd number of shingles there, so two sets differ in at least as many shingles as their parities do in classes.
   What the hashes say is linked is decided by the words themselves.
   Texts are fetched for candidates only: a Bloom filter of their ids keeps the others out of the shuffle.
5. Linked nodes get component labels. In long runs only pairs between components that all filters let by are left, so a large
   group of near copies costs about its size, not its square (runs of over RUN rows are dealt out in parts, by the rows of the
   main component; rows that no size in the run suits stay out). What they add joins the links for the final components. No link
   between components is skipped: every pair that passes the filters is verified or already in one component.

Documents of null or empty text, or without words, have no shingles and link with nothing. Rows of a null id link with nothing.
Rows that share an id but not the text are told apart by digest. Repeated rows and equal word sequences are one node whatever their number.
Very long texts are used whole. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm import bloom
from hustings.llm.batches import pieces
from hustings.llm.components import components
from hustings.llm.shingles import exact_shingles, mixed, shingle_sets, spelling, words_of
from hustings.workers import importable, temporary, written

K, PERCENT = 4, 85
#: Counters of the sketch (a power of two) and counters a block of it; pairs of runs up to SHORT are all tried;
#: neighbours along a chain that a row of a longer run is tried with; partners in a part; rows of a run that aren't dealt out further.
BUCKETS, SLICE, SHORT, CHAIN, BLOCK, RUN = 1 << 20, 1 << 14, 8, 4, 256, 512
#: Places of the bit map (16 MB), and of a block of it.
PLACES, MAP_BLOCK = 1 << 27, 1 << 20
#: Classes of shingles of the suffix filter (a power of two), and bits of the filter of ids (4 MB).
CLASSES, ID_BITS = 512, 1 << 25
#: Tasks whose sketches are joined at once; a shingle is very common if its counter is over HEAVY and over SPREAD times the mean one.
FAN, HEAVY, SPREAD = 32, 1024, 8


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of n and m need: |A & B| * 100 >= percent * |A | B|."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _spelt(texts: list[str | None], sets: list[np.ndarray]) -> list[tuple[int | None, int | None]]:
    """128 bits of each text's lower-cased words; none of texts without words."""
    return [spelling(b" ".join(words_of(t, lower=True))) if len(s) else (None, None) for t, s in zip(texts, sets, strict=True)]


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Whether there is an odd number of shingles in each class, as bits."""
    odd = np.bincount((shingles >> np.uint64(64 - (CLASSES.bit_length() - 1))).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def _near_enough(parity: np.ndarray, others: np.ndarray, n, m, percent: int) -> np.ndarray:
    """Suffix filter: sets that share enough differ in at most n + m - 2 * least overlap shingles."""
    return np.bitwise_count(parity ^ others).sum(-1, dtype=np.int64) <= n + m - 2 * least_overlap(n, m, percent)


def _measure(k: int, buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sketch = np.zeros(buckets, np.uint32)
        once, twice = np.zeros(PLACES // 8, np.uint8), np.zeros(PLACES // 8, np.uint8)
        for part in pieces(batches):
            texts = part.column(1).to_pylist()
            sets = shingle_sets(texts, k)
            if any(map(len, sets)):
                sketch += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=buckets).astype(np.uint32)
            for s in sets:
                at, bit = _place(s)
                np.bitwise_or.at(twice, at, once[at] & bit)
                np.bitwise_or.at(once, at, bit)
            keys = _spelt(texts, sets)
            yield _rows([part.column(0).to_pylist(), [len(s) for s in sets], [a for a, _ in keys], [b for _, b in keys], [_parity(s).tobytes() if len(s) else None for s in sets], *[[None] * len(sets)] * 4])
        for at in range(0, buckets, SLICE):
            if sketch[at : at + SLICE].any():
                yield _rows([*[[None]] * 5, [at], [task], [zlib.compress(sketch[at : at + SLICE].tobytes(), 1)], [None]])
        for at in range(0, PLACES // 8, MAP_BLOCK // 8):
            block = slice(at, at + MAP_BLOCK // 8)
            if once[block].any():
                yield _rows([*[[None]] * 5, [-1 - at], [task], [zlib.compress(once[block].tobytes(), 1)], [zlib.compress(twice[block].tobytes(), 1)]])

    return run


def _place(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each shingle in the map; low bits, for the high ones number the buckets."""
    place = (shingles & np.uint64(PLACES - 1)).astype(np.int64)
    return place >> 3, np.uint8(1) << (place & 7).astype(np.uint8)


MEASURED = "doc_id long, n long, hi long, lo long, parity binary, at long, part long, counts binary, more binary"
SKETCHED = "at long, part long, counts binary, more binary"


def _rows(columns: list[list], schema: str = MEASURED) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of the sketches of several tasks: counters are added (at >= 0), places touched once and more often are told apart."""
    inflated = lambda column, kind: (np.frombuffer(zlib.decompress(x), kind) for x in pdf[column])
    packed = lambda x: [zlib.compress(x.tobytes(), 1)]
    first = pdf[["at", "part"]].head(1).reset_index(drop=True)
    if first["at"][0] >= 0:
        total = sum(c.astype(np.uint64) for c in inflated("counts", np.uint32))
        return first.assign(counts=packed(np.minimum(total, 2**32 - 1).astype(np.uint32)), more=None)
    once, twice = np.zeros(MAP_BLOCK // 8, np.uint8), np.zeros(MAP_BLOCK // 8, np.uint8)
    for a, b in zip(inflated("counts", np.uint8), inflated("more", np.uint8), strict=True):
        twice |= b | (once & a)
        once |= a
    return first.assign(counts=packed(once), more=packed(twice))


def _sketches(blocks: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters, and the bits of places that one document alone touches; of fixed size in all."""
    tasks = blocks.agg(F.max("part")).first()[0] or 0
    while True:
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("at", "part").applyInPandas(_joined, SKETCHED)
        tasks //= FAN
        if not tasks:
            break
    counts, alone = np.zeros(buckets, np.uint32), np.zeros(PLACES // 8, np.uint8)
    for r in blocks.toLocalIterator():  # 4 * buckets + PLACES / 4 bytes in all
        got = zlib.decompress(r["counts"])
        if r["at"] >= 0:
            counts[r["at"] : r["at"] + SLICE] = np.frombuffer(got, np.uint32)
        else:
            alone[-1 - r["at"] : -1 - r["at"] + MAP_BLOCK // 8] = np.frombuffer(got, np.uint8) & ~np.frombuffer(zlib.decompress(r["more"]), np.uint8)
    return counts, alone


def _prefixes(k: int, percent: int, counts, alone, buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    heavy = max(HEAVY, SPREAD * int(counts.value.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sketch = counts.value
        for part in pieces(batches):
            columns: list[list[np.ndarray]] = [[] for _ in DEALT.split(", ")]
            texts = part.column(1).to_pylist()
            sets = shingle_sets(texts, k)
            for s, key in zip(sets, _spelt(texts, sets), strict=True):
                if not len(s) or key in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                n = len(s)
                p = prefix_length(n, percent)
                at, bit = _place(s)
                rare = (alone.value[at] & bit) > 0
                order = np.argsort(np.where(rare, 0, sketch[(s >> shift).astype(np.int64)]), kind="stable")[:p]  # s ascends: ties by hash
                pos = np.flatnonzero(~rare[order])
                m, token = len(pos), s[order[pos]]
                parts = sketch[(token >> shift).astype(np.int64)] // heavy + 1
                deal = np.where(parts > 1, mixed(token ^ mixed((key[0] % parts.astype(np.int64)).astype(np.uint64) + np.uint64(1))), token)
                for c, x in zip(columns, (deal.view(np.int64), token.view(np.int64), np.full(m, n), pos, np.full(m, key[0]), np.full(m, key[1])), strict=True):
                    c.append(x)
            if columns[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=[f.split()[0] for f in DEALT.split(", ")])

    return run


PREFIX = "token long, n long, pos long, hi long, lo long"
DEALT = f"deal long, {PREFIX}"  # deal is the token, or names one part of a very common one


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of whole runs of rows with an equal key, of rows sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[0]):
            first = int(np.flatnonzero(keys != held[-1].column(key)[-1].as_py())[0]) if held[-1].column(key)[-1].as_py() == keys[0] else 0
            yield _columns([*held, pa.Table.from_batches([batch.slice(0, first)])])
            held = []
            if cut > first:
                yield _columns([pa.Table.from_batches([batch.slice(first, cut - first)])])
            held = [pa.Table.from_batches([batch.slice(cut)])]
        elif cut:
            yield _columns([pa.Table.from_batches([batch.slice(0, cut)])])
            held = [pa.Table.from_batches([batch.slice(cut)])]
        else:
            held.append(pa.Table.from_batches([batch]))
    if held:
        yield _columns(held)


def _columns(tables: list[pa.Table]) -> dict[str, np.ndarray]:
    t = pa.concat_tables(tables)
    return {c: t.column(c).to_numpy() if t.schema.field(c).type != pa.binary() else np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(t.num_rows, -1) for c in t.column_names}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (deal, token, hi, lo): without repeats, and only tokens of more than one node or dealt out in parts."""
    for c in _runs(batches, "deal"):
        new = np.ones(len(c["deal"]), bool)
        new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("deal", "token", "hi", "lo")])
        c = {k: v[new] for k, v in c.items()}
        starts = np.flatnonzero(np.append(True, (c["deal"][1:] != c["deal"][:-1]) | (c["token"][1:] != c["token"][:-1])))
        size = np.diff(np.append(starts, len(c["deal"])))
        deal = c.pop("deal")
        keep = np.repeat(size > 1, size) | (deal != c["token"])
        if keep.any():
            yield pa.record_batch([pa.array(v[keep]) for v in c.values()], names=list(c))


def _allowed(n, p, m, q, percent: int) -> np.ndarray:
    """Length and positional filter for the first shared shingle, at p of n and q of m."""
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= least_overlap(n, m, percent))


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _first_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches, "token"):
            luck = mixed(c["doc"].astype(np.uint64) ^ mixed(c["token"].view(np.uint64)))
            order = np.lexsort((luck, c["token"]))
            token, doc, n, pos = (c[k][order] for k in ("token", "doc", "n", "pos"))
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(starts, len(token)))
            mine = np.repeat(size, size)
            pairs = []
            for step in range(1, SHORT):
                i = np.flatnonzero((token[step:] == token[:-step]) & ((mine[step:] <= SHORT) | (step <= CHAIN)))
                j = i + step
                ok = _allowed(n[i], pos[i], n[j], pos[j], percent)
                pairs.append((doc[i[ok]], doc[j[ok]]))
            yield from _distinct(pairs)

    return run


def _later_pairs(percent: int):
    """Between components, in runs longer than SHORT or parts of such; rows have label and parity, part, split (parts of the run), home and is_main."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches, "token"):
            new = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("token", "split", "part")])
            starts = [*np.flatnonzero(np.append(True, new)), len(c["token"])]
            for a, b in pairwise(starts):
                names, own = np.unique(c["label"][a:b], return_inverse=True)
                if len(names) < 2:
                    continue
                doc, n, pos, parity, home = (c[k][a:b] for k in ("doc", "n", "pos", "parity", "home"))
                part, split = int(c["part"][a]), int(c["split"][a])
                main = c["is_main"][a:b]
                large, small = np.flatnonzero(main), np.flatnonzero(~main)
                small = small[np.argsort(home[small], kind="stable")]  # of two rows that lie in every part, one part has the pair
                first = np.searchsorted(home[small], np.arange(split + 1))
                pairs, held = [], 0
                for k, i in enumerate(small):
                    mate = (part - home[i]) % split
                    j = np.concatenate([large, small[first[mate] : min(k, first[mate + 1])]])  # each pair once
                    j = j[own[j] != own[i]]
                    j = j[_allowed(n[i], pos[i], n[j], pos[j], percent)]
                    j = j[_near_enough(parity[i], parity[j], n[i], n[j], percent)]
                    pairs.append((np.full(len(j), doc[i]), doc[j]))
                    held += len(j)
                    if held > 1 << 20:
                        yield from _distinct(pairs)
                        pairs, held = [], 0
                yield from _distinct(pairs)

    return run


def _verified(k: int, percent: int):
    """Rows sorted by (a, salt, b null first): the leader's text, then its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, key, parity, exact = None, None, None, None
        for part in pieces(batches, 6):
            found = []
            texts = part.column(6).to_pylist()
            sets = shingle_sets(texts, k)
            for a, salt, b, hi, lo, s, spelt, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), sets, _spelt(texts, sets), texts, strict=True):
                if spelt != (hi, lo):
                    continue  # another row with the same id
                if b is None:
                    lead, key, parity, exact = s, (a, salt), _parity(s), exact_shingles(words_of(text, lower=True), k)
                elif key == (a, salt) and _near_enough(parity, _parity(s), len(lead), len(s), percent):
                    if len(np.intersect1d(lead, s, assume_unique=True)) >= least_overlap(len(lead), len(s), percent):
                        other = exact_shingles(words_of(text, lower=True), k)  # equal hashes don't make equal words
                        if len(exact & other) >= least_overlap(len(exact), len(other), percent):
                            found.append((a, b))
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b); texts: doc, n, hi, lo, text of all nodes in pairs."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    mates = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    leads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    as_b = texts.withColumnRenamed("doc", "b")
    as_a = texts.withColumnRenamed("doc", "a")
    rows = mates.join(as_b, "b").select("a", "salt", "b", "n", "hi", "lo", "text").unionByName(leads.join(as_a, "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "hi", "lo", "text"))
    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_verified(k, percent), "a long, b long")


def link(docs: DataFrame, k: int = K, percent: int = PERCENT, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with temporary(spark) as keep:
        return keep(written(_linked(rows, k, percent, buckets), "linked"))


def _linked(rows: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """The result, from intermediate tables that it still needs."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = written(rows.mapInArrow(_measure(k, buckets), MEASURED), "shingle-counts")
    found = measured.filter("at IS NULL").select("doc_id", "n", "hi", "lo", "parity")
    counts, alone = map(spark.sparkContext.broadcast, _sketches(measured.filter("at IS NOT NULL").select("at", "part", "counts", "more"), buckets))

    nodes = written(found.filter("hi IS NOT NULL AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.max("parity").alias("parity")), "nodes")
    prefixes = rows.mapInArrow(_prefixes(k, percent, counts, alone, buckets), DEALT)
    shared = written(prefixes.repartition(parts, "deal").sortWithinPartitions("deal", "token", "hi", "lo").mapInArrow(_shared, PREFIX), "shared")
    tokens = written(shared.join(nodes.select("hi", "lo", "doc"), ["hi", "lo"]).select("token", "doc", "n", "pos"), "tokens")
    wanted = written(nodes.join(tokens.select("doc").distinct(), "doc", "left_semi"), "wanted")
    near = bloom.only(rows, "doc_id", bloom.build(wanted, "doc", ID_BITS))
    texts = written(wanted.join(near, F.col("doc") == F.col("doc_id")).select("doc", "n", "hi", "lo", "text"), "texts")

    dealt = lambda t, *more: t.repartition(parts, "token").sortWithinPartitions("token", *more)
    split = lambda token, part: F.xxhash64(token, part)  # noqa: E731  a part of a run; two that fell together would only add candidates
    runs = tokens.groupBy("token").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).filter(F.col("rows") > SHORT)
    hot = written(runs, "runs").withColumn("split", F.ceil(F.col("rows") / RUN).cast("int"))
    salted = tokens.join(hot.filter("split > 1").select("token", "split"), "token", "left").withColumn("token", F.when(F.col("split").isNull(), F.col("token")).otherwise(split("token", F.pmod(F.xxhash64("doc"), F.col("split")))))
    first = written(dealt(salted.drop("split")).mapInArrow(_first_pairs(percent), "a long, b long").distinct(), "pairs")
    links = written(_verify(first, texts, k, percent), "links")
    labels = written(components(links), "labels")

    smallest = F.greatest("least", F.ceil(percent * F.col("n") / 100))  # the partner in the run that asks least of a row
    suits = (smallest <= F.col("most")) & (F.col("n") - F.col("pos") >= F.ceil(percent * (F.col("n") + smallest) / (100 + percent)))
    rest = tokens.join(hot.select("token", "split", "least", "most"), "token").filter(suits).select("token", "split", "doc", "n", "pos")
    rest = rest.join(labels.withColumnRenamed("node", "doc"), "doc", "left").join(wanted.select("doc", "parity"), "doc")
    # written before it is counted, so that rows of a common token are counted where they lie and not by token
    rest = written(rest.withColumn("label", F.coalesce("component", "doc")).drop("component"), "later")
    most = rest.groupBy("token", "label").agg(F.count("*").alias("rows")).groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels"))
    rest = rest.join(written(most.filter("labels > 1").select("token", "main"), "mains"), "token")
    # of a long run, rows of the main component lie in one part each, the others in every part: all pairs between components still meet
    # and two rows that are in every part meet in the part that the sum of their own parts names
    rest = rest.withColumns({"is_main": F.col("label") == F.col("main"), "home": F.pmod(F.xxhash64("doc"), F.col("split")).cast("int")})
    every = F.when(F.col("is_main") | (F.col("split") == 1), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("split") - 1))
    rest = rest.withColumn("part", F.explode(every)).withColumn("token", F.when(F.col("split") == 1, F.col("token")).otherwise(split("token", F.col("part").cast("long"))))
    rest = rest.select("token", "doc", "n", "pos", "label", "parity", "part", "split", "home", "is_main")
    later = dealt(rest, "split", "part").mapInArrow(_later_pairs(percent), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = written(_verify(written(later, "pairs"), texts, k, percent), "links")
    joined = components(links.unionByName(more)) if more.take(1) else labels

    own = found.join(nodes.select("hi", "lo", "doc"), ["hi", "lo"], "left").withColumnRenamed("doc", "node").join(joined, "node", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, with all columns: the one with the smallest id. An id goes only if no row of it stays."""
    linked = link(docs, k, percent, buckets, id_col, text_col)
    gone = written(linked.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")).filter("stays = 0").select(F.col("doc_id").alias("__jaccard_gone")), "gone")
    return docs.join(gone, docs[id_col] == gone["__jaccard_gone"], "left_anti")

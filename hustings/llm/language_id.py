"""Language identification by nearest centroid.

A text, lower-cased, is cut into n-grams of 2 to 4 UTF-8 bytes within letters and single spaces, hashed to `FEATURES` counters.
Vectors are (1 + log count) * idf, scaled to length one. Per language a bounded sample of labelled rows is clustered by
spherical k-means into up to `clusters` centroids (those without rows are dropped); a text gets the language of the centroid
with the largest cosine. It is rejected if its cosine lies below that centroid's limit for texts of its length. Lengths are
bands of distinct n-grams, a power of two each. In each, the limit is mean minus `spread` standard deviations of the
logarithm of the cosine, so it is above 0. They are measured on the sampled texts whole and on a piece of each of the lengths
PIECES, each against centroids without its own text; a deviation counts as LEAST_SD at least. Fewer than LEAST_ROWS in a
band: those of the language count instead, then of all languages, then of the nearest band, then all.

The sample has at most `per_language` rows a language, chosen by a hash of the id, over at most MOST_LANGUAGES languages (more
raise ValueError); each is used whole. idf is part of the fitted classifier. Null text, or text without a letter, is `und`
with score 0 and rejected. Without labelled rows every text is `und`. Repeated rows predict alike; ties go to the language
that sorts first. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.batches import pieces, quoted
from hustings.workers import importable, temporary, written

FEATURES = 1 << 14
PER_LANGUAGE, MOST_LANGUAGES, CLUSTERS, SPREAD = 300, 256, 4, 6.0
BANDS, PIECES, LEAST_ROWS, LEAST_SD = FEATURES.bit_length() + 1, (8, 16, 32, 64, 128, 256, 512, 1024, 2048), 20, 0.2
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BLANK = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of one text."""
    raw = b" " + b" ".join(text.lower().encode(errors="replace").translate(BLANK).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES, np.int64)
    gram = a
    for n in range(2, 5):
        gram = gram[:-1] * np.uint32(0x01000193) ^ a[n - 1 :] * np.uint32(0x9E3779B1)
        if len(gram):
            out += np.bincount((gram * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int64), minlength=FEATURES)
    return out


def weights(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur, and their part of the vector of length one."""
    at = np.flatnonzero(n)
    v = (1 + np.log(n[at])) * idf[at]
    return at, v / max(np.linalg.norm(v), 1e-12)


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros(FEATURES)
    at, v = weights(n, idf)
    out[at] = v
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # features x centroids
    languages: list[str]  # of each centroid
    limits: np.ndarray  # least cosine, centroids x bands

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, rejected."""
        if text is None or not len(self.languages) or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        at, v = weights(counts(text), self.idf)
        cosine = v @ self.centroids[at]
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < self.limits[best, len(at).bit_length()])


def _clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from evenly spaced rows along the order of likeness to the mean; (centroids, cluster of each row)."""
    order = np.argsort(vectors @ vectors.mean(0), kind="stable")
    centroids = vectors[order[np.linspace(0, len(order) - 1, min(k, len(order))).astype(int)]]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, 1)
        sums = np.stack([vectors[own == c].sum(0) for c in range(len(centroids))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-12), centroids)
    return centroids, np.argmax(vectors @ centroids.T, 1)


def pieces_of(text: str, luck: float) -> list[str]:
    """A piece of each of the lengths that are shorter than the text, from a place by luck (0 to 1), of whole words where it has any."""
    out = []
    for size in PIECES:
        if size < len(text):
            at = int((len(text) - size) * luck)
            piece = text[at : at + size]
            whole = piece[piece.find(" ") + 1 if at else 0 : piece.rfind(" ") + 1]
            out.append(whole if LETTER.search(whole) else piece)
    return [t for t in out if LETTER.search(t)]


def _measures(at: np.ndarray, v: np.ndarray, centroids: np.ndarray, row: np.ndarray, own: int, sums: np.ndarray, alone: bool) -> tuple[int, float]:
    """Nearest centroid and log cosine, where the text's own vector (row) is left out of its centroid; -1 if there is no other text."""
    cosine = centroids[:, at] @ v
    if alone:
        cosine[own] = -1
    else:
        rest = sums[own] - row
        cosine[own] = rest[at] @ v / max(np.linalg.norm(rest), 1e-12)
    best = int(np.argmax(cosine))
    return (best if cosine[best] >= 0 else -1), float(np.log(max(cosine[best], 1e-3)))


def _limits(stats: np.ndarray, languages: list[str], spread: float) -> np.ndarray:
    """Least cosines, centroids x bands, from (number, sum, sum of squares) of log cosines, 3 x centroids x bands."""
    every = stats.sum(1)
    full = np.flatnonzero(every[0] >= LEAST_ROWS)
    out = np.zeros(stats.shape[1:])
    for c, lang in enumerate(languages):
        same = stats[:, [x == lang for x in languages]].sum(1)
        for b in range(BANDS):
            near = full[np.argmin(abs(full - b))] if len(full) else None
            n, s, q = next((x for x in (stats[:, c, b], same[:, b], every[:, b]) if x[0] >= LEAST_ROWS), every.sum(1) if near is None else every[:, near])
            if n:
                out[c, b] = np.exp(s / n - spread * max(np.sqrt(max(q / n - (s / n) ** 2, 0)), LEAST_SD))
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, spread: float = SPREAD) -> Model:
    """Learn from rows with a language and a text; sampled, clustered and measured on the executors, centroids alone come back."""
    with temporary(labelled.sparkSession):  # the sample goes when it has been learnt from
        return _fitted(labelled, id_col, text_col, lang_col, per_language, clusters, spread)


def _fitted(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, clusters: int, spread: float) -> Model:
    importable(labelled.sparkSession)
    known = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).filter("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    nothing = Model(np.ones(FEATURES), np.zeros((FEATURES, 0)), [], np.zeros((0, BANDS)))
    if not sizes:
        return nothing
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 1.2 * per_language / n))])
    luck = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / (1 << 30)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = part.column(1).to_pylist()
            keep = [k for k, t in enumerate(texts) if LETTER.search(t)]
            lang, h = (part.column(c).take(pa.array(keep, pa.int64())) for c in (0, 2))
            cut = [pieces_of(texts[k], x * 1009 % 1) for k, x in zip(keep, h.to_pylist())]
            yield pa.record_batch([lang, pa.array([counts(texts[k]).astype("<u4").tobytes() for k in keep], pa.binary()), h, pa.array(cut, pa.list_(pa.string()))], names=["l", "n", "h", "cut"])

    sample = known.withColumn("h", luck).filter(F.col("h") < F.element_at(share, F.col("l"))).select("l", F.col("t"), "h")
    table = written(sample.mapInArrow(measured, "l string, n binary, h double, cut array<string>"), "language-sample")

    def first(pdf):
        return pdf.sort_values(["h", "n"]).head(per_language)

    def capped(pdf):
        return np.stack([np.frombuffer(b, "<u4") for b in first(pdf)["n"]])

    def spreadth(key, pdf):
        import pandas as pd

        return pd.DataFrame({"l": [key[0]], "rows": [min(len(pdf), per_language)], "df": [(capped(pdf) > 0).sum(0).astype("<i8").tobytes()]})

    df = table.groupBy("l").applyInPandas(spreadth, "l string, rows long, df binary").collect()
    if not df:
        return nothing
    idf = np.log((1 + sum(r["rows"] for r in df)) / (1 + sum(np.frombuffer(r["df"], "<i8") for r in df))) + 1

    def centred(key, pdf):
        import pandas as pd

        vectors = np.stack([vector(n, idf) for n in capped(pdf)])
        centroids, own = _clustered(vectors, clusters)
        sums, size = np.stack([vectors[own == c].sum(0) for c in range(len(centroids))]), np.bincount(own, minlength=len(centroids))
        centroids[size == 0] = 0
        stats = np.zeros((len(centroids), 3, BANDS))
        for row, c, cut in zip(vectors, own, first(pdf)["cut"]):
            at = np.flatnonzero(row)
            for on, v in [(at, row[at])] + [weights(counts(t), idf) for t in cut]:
                best, x = _measures(on, v, centroids, row, c, sums, size[c] < 2)
                if best >= 0:
                    stats[best, :, len(on).bit_length()] += 1, x, x * x
        there = np.flatnonzero(size)
        return pd.DataFrame({"l": [key[0]] * len(there), "c": [centroids[c].astype("<f8").tobytes() for c in there], "stats": [stats[c].astype("<f8").tobytes() for c in there]})

    found = sorted(table.groupBy("l").applyInPandas(centred, "l string, c binary, stats binary").collect(), key=lambda r: (r["l"], r["c"]))
    languages = [r["l"] for r in found]
    stats = np.stack([np.frombuffer(r["stats"], "<f8").reshape(3, BANDS) for r in found], 1)
    return Model(idf, np.stack([np.frombuffer(r["c"], "<f8") for r in found], 1), languages, _limits(stats, languages, spread))


def classified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, guess): each row of docs as a struct, whatever its columns are called, and guess: lang_pred, score, rejected."""
    importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    # nondeterministic: else a filter on its result makes the optimizer run it twice
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(texts):
        import pandas as pd

        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    return docs.select(row, guess.asNondeterministic()(F.col(quoted(text_col))).alias("guess"))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced)."""
    found = ("lang_pred", "score", "rejected")
    own = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c not in found]
    return classified(docs, model, text_col).select(*own, *[F.col(f"guess.{c}").alias(c) for c in found])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from learning; those of a null id aren't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))

"""From documents to packed training sequences: language ID, exact dedup, Jaccard dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one. All
but the last return the columns of documents. Clean documents stay in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm import exact_dedup, jaccard_join, language_id, packing, secret_scan
from hustings.llm.batches import quoted
from hustings.workers import temporary, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, doesn't reject; lang becomes what it predicts."""
    found = language_id.classified(docs, language_id.fit(docs)).filter("NOT guess.rejected")
    return found.select(*[F.col("guess.lang_pred" if c == "lang" else f"row.{quoted(c)}").alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the document with the smallest id."""
    return jaccard_join.deduplicate(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows."""
    length = F.length("text").cast("long").alias("n_chars")
    return secret_scan.redact(docs).select(*[length if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as packing.pack gives them."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remember=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenization, n-gram centroids and packing are not SQL; the pipeline is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark) as last:
        for name, stage in STAGES:
            with temporary(spark) as keep:  # a stage's own tables go when it is written
                docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        return last(docs)

"""The pipeline's stages, one by one and together, against plain Python."""

import os
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from hustings.llm import secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        steps.append({name: docs})
        if name != "packing":
            assert docs.columns == columns
    rows = [[*s.values()][0].collect() for s in steps]
    every = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows[0]} == {i for i, r in every.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    best = {}
    for r in rows[0]:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in rows[1]} == set(best.values())
    sets = {r.doc_id: shingles(r.text) for r in rows[1]}
    label = {i: i for i in sets}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i in sorted(sets):
        for j in sorted({j for x in sets[i] for j in by[x]} - {i}):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert {r.doc_id for r in rows[2]} == {i for i, v in label.items() if i == v}
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]}
    for r in rows[3]:
        assert r.n_chars == len(r.text) and not re.search("|".join([secret_scan.HEX.replace("+", "{16,}"), "AKIA[A-Z0-9]{14,}"]), r.text)
        if "[SECRET]" not in r.text:
            assert r.text == every[r.doc_id].text
    assert {r.doc_id for r in rows[4]} == {r.doc_id for r in rows[3]}
    total = defaultdict(int)
    for r in rows[4]:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows[4])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= {*out.columns} and out.count() > 0


def test_columns_of_any_name_survive_every_stage(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "rejected", "lang_pred", "a.b", "back`tick", "guess", "row", "rank", "keep", "heavy", "spans", "guess.score"]
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.col("doc_id") * 10 + k)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert got and all(r[c] == r.doc_id * 10 + k for r in got for k, c in enumerate(names))

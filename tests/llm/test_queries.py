"""The registered queries on the smallest tables, whole, against plain Python and the libraries."""

import hashlib
import os
import re
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest
from test_embedding import brute as brute_links
from test_jaccard import brute as brute_jaccard
from test_native import base, entropy_spans
from test_substring import brute as brute_repeats

from hustings.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df, names, schema):
    assert [c for c, _ in df.dtypes][: len(names)] == names and dict(df.dtypes) | schema == dict(df.dtypes)
    out = {r[0]: tuple(r)[1:] for r in df.collect()}
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    got = by_id(queries.op1_sentencepiece(spark, SF), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], {"n_tokens": "bigint"})
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(sp.decode(ids)))


def test_op2(spark, docs):
    got = by_id(queries.op2_substring_dedup(spark, SF), ["doc_id", "n_words", "n_removed", "kept_sha256"], {"n_words": "bigint", "n_removed": "bigint"})
    assert got == {i: (n, gone, sha(kept)) for i, n, gone, kept in brute_repeats(list(docs.items()), 50)}


def tokenized(docs, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    return {i: [*e.ids, end] for i, e in zip(docs, t.encode_batch([x or "" for x in docs.values()], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, docs):
    got = by_id(queries.op3_token_files(spark, SF), ["doc_id", "start", "n_tokens", "ids_crc32"], {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    at, want = 0, {}
    for i, ids in sorted(tokenized(docs, 2).items()):
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_op4(spark, docs):
    got = by_id(queries.op4_language_id(spark, SF), ["doc_id", "held_out", "lang_pred", "score"], {"held_out": "boolean", "score": "double"})
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    known = {x for x in labels.values() if x}
    assert got.keys() == docs.keys()
    for i, (held, pred, score, *_) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1
        letters = docs[i] is not None and any(c.isalpha() for c in docs[i])
        assert pred in known if letters else pred == "und"
    told = [got[i][1] == labels[i] for i in got if got[i][0] and labels[i] and got[i][1] != "und"]
    assert sum(told) / len(told) > 0.95


def test_op6(spark, docs):
    got = by_id(queries.op6_secret_scan(spark, SF), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], {"n_hex": "bigint"})
    for i, t in docs.items():
        spans, found = base(t or ""), [s for s in got[i][4].split(",") if s]
        kinds = [s.split(":")[0] for s in spans.split(",")]
        assert got[i][:4] == (*(kinds.count(k) for k in ("assign", "access", "hex")), sha(spans))
        assert ",".join(s for s in found if not s.startswith("entropy")) == spans and [s for s in found if s.startswith("entropy")] == entropy_spans(t or "")


def test_op7(spark, docs):
    ids = tokenized(docs, 1)
    df = queries.op7_packing(spark, SF)
    assert [c for c, _ in df.dtypes][:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    for i, own in pieces.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == len(ids[i]) and all(a[1] == b[0] for a, b in pairwise(own))
    assert pieces.keys() == ids.keys()
    padded = 0
    for own in sequences.values():
        own.sort()
        n = own[-1][1]
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in pairwise(own)) and n <= 2048
        padded += 0 if n & (n - 1) == 0 else 2048 - n
    assert padded < 0.02 * sum(map(len, ids.values()))


def test_op8(spark, docs):
    got = by_id(queries.op8_jaccard_join(spark, SF), ["doc_id", "n_shingles", "component_id"], {"n_shingles": "bigint", "component_id": "bigint"})
    assert got == {i: (n, c) for i, n, c in brute_jaccard(list(docs.items()), 4, 85)}


def test_op9(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = queries.op9_embedding_dedup(spark, SF)
    assert [c for c, _ in df.dtypes][:4] == ["vec_id", "n_links", "component_id", "kept"]
    got = df.collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_native_plans_have_no_python(spark):
    for name in ("op5_chat_format", "op6_secret_scan", "op10_exact_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name

"""SentencePiece rounds, token files and packing against the libraries and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.llm import packing, sentencepiece_codec, token_files, word_tokens

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
random.seed(5)
HARD = [
    None, "", " ", "  ", "a  b", " a", "a ", "\n", "a\nb", "a \n b", "\n\n x\n", "x▁y", "▁", "\t\r\nZ", "ﬁ ① ｶ", "é é", "​﻿z", "<s> </s> <unk> <0x41>", "a\0b", "\x1c\x1d a\x85b c",
    "日本語 テキスト", "😀😀 👩‍👩‍👧", "𝔘𝔫𝔦", "aaaaaaaaaaaaaaaaaaa" * 30, " " * 300 + "x" + " " * 40, "abab" * 2000, "".join(random.choices("abcdefgh", k=9000)), "It's don't I'LL we'd", "İSTANBUL ΑΣ ΑΣΑ ǅ",
    "<|endoftext|>x<|startoftext|> <|endoftext|", "12345 6,7.8 !!??", "naïvé ́x", "The quick brown fox\njumps over  the lazy dog. " * 50,
]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def own():
    return sentencepiece_codec.Codec(PIECES)


def test_sentencepiece_hard_texts(sp, own):
    for t, got in zip(HARD, own.encode(HARD), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == sp.encode(t or ""), repr(t)[:80]
        assert own.decode(np.array([1, *ids, 2], "<u4").tobytes()) == sp.decode([1, *ids, 2])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n▁abethin<>/s|é́日😀.")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_sentencepiece_any_text(sp, own, t):
    ids = np.frombuffer(own.encode([t])[0], "<u4").tolist()
    assert ids == sp.encode(t)
    assert own.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=20))
def test_sentencepiece_decodes_any_ids(sp, own, ids):
    assert own.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)


def test_sentencepiece_merges_equal_pairs_at_once(own, sp):
    parts = ["the", "ing", "tion", "under", "stand", "aaa", "ababab", "xyxy", "é", "漢字", "isis"]
    texts = ["".join(random.choices(of, k=n)) for n in (3, 8, 40, 3000) for of in (parts, "ab", "abcdeth", "aab") for _ in range(30 if n < 100 else 2)]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == sp.encode(t), t[:80]


def test_sentencepiece_forgets(own, sp, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 3)
    for t in ("one two three four", "five one", "one two three four"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == sp.encode(t)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_word_tokens_hard_texts(plain):
    own = word_tokens.WordEncoder(WORDS)
    for t, got in zip(HARD, own.encode(HARD), strict=True):
        assert np.frombuffer(got, own.dtype).tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x85'stABΣσ́<|endoftext|>é1２")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_tokens_any_text(plain, t):
    own = word_tokens.encoder(WORDS)
    assert np.frombuffer(own.encode([t])[0], own.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids


ROWS = [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(None, "no id", None, 2), (3, "a  b", None, None), (3, "other", None, None)]
SCHEMA = "doc_id long, text string, ids string, start int"


def test_encode_decode_on_spark(spark, sp):
    rows = sentencepiece_codec.encode_decode(spark.createDataFrame(ROWS, SCHEMA), PIECES).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            want = [1, *sp.encode(HARD[r.doc_id] or ""), 2]
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == sp.decode(want)
    assert sentencepiece_codec.encode_decode(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_token_files_round_trip(spark, plain, tmp_path):
    folder = f"file://{tmp_path}/tok"
    manifest = token_files.write(spark.createDataFrame(ROWS, SCHEMA), folder, WORDS, frame_tokens=64)
    rows = token_files.read(manifest, folder).orderBy("start").collect()
    assert len(rows) == len(ROWS) and [r.doc_id for r in rows] == [None, *sorted(r[0] for r in ROWS if r[0] is not None)]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
        if r.doc_id not in (None, 3):
            assert np.frombuffer(r.ids, "<u4").tolist() == [*plain.encode(HARD[r.doc_id] or "", add_special_tokens=False).ids, 2]
    some = token_files.lookup(manifest, folder, [3, 30, 777]).collect()
    assert sorted(r.doc_id for r in some) == [3, 3, 3, 30] and all(r.ids in [x.ids for x in rows if x.doc_id == r.doc_id] for r in some)
    assert token_files.lookup(manifest, folder, []).count() == 0
    empty = token_files.write(spark.createDataFrame([], SCHEMA), folder, WORDS)
    assert empty.count() == 0 and token_files.read(empty, folder).count() == 0


def test_token_file_access_and_damage(tmp_path):
    path, docs = str(tmp_path / "a.tok"), [(5, b""), (7, b"ab" * 10), (None, b"cd" * 300), (9, b"ef"), (7, b"gh" * 33)]
    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_output_stream(path) as sink:
        w = token_files.Writer(sink, np.dtype("<u2"), frame_tokens=64)
        for d in docs:
            w.add(*d)
        w.close()
    reader = token_files.Reader(fs.open_input_file(path))
    assert [reader.document(i) for i in range(5)] == [d[1] for d in docs] and reader.find(7) == [1, 4] and reader.find(0) == []
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    reader.document(4)
    assert len(opened) == 1 < len(reader.raw)
    data = bytearray(open(path, "rb").read())
    import zstandard

    data[: int(reader.packed[0])] = zstandard.ZstdCompressor(level=3, write_checksum=False).compress(b"xy" * 10)[: int(reader.packed[0])].ljust(int(reader.packed[0]), b"\0")
    open(path, "wb").write(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(fs.open_input_file(path)).document(1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([0, 2, 8]))
def test_packing_covers_each_token_once(lengths, slack):
    sequences = packing.best_fit_decreasing(lengths, 64, slack)
    seen = sorted(p for s in sequences for p in s)
    for d, n in enumerate(lengths):
        at = 0
        for _, s, k in (p for p in seen if p[0] == d):
            assert s == at and k > 0
            at += k
        assert at == n
    for s in sequences:
        total = sum(p[2] for p in s)
        assert 0 < total <= 64 and (64 - total <= slack or total & (total - 1) == 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.booleans()), max_size=80), st.integers(0, 99))
def test_capacity_tree_finds_the_tightest(steps, need):
    tree, held = packing.CapacityTree(100), []
    for c, add in steps:
        if add:
            held.append(c)
            tree.add(c, 1)
        elif c in held:
            held.remove(c)
            tree.add(c, -1)
    assert tree.tightest(need) == min((c for c in held if c >= need), default=None)


def test_packing_on_spark(spark, plain):
    rows = packing.pack(spark.createDataFrame(ROWS, SCHEMA), WORDS, block=3000).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, t in enumerate(HARD):
        if i != 3:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
            assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 1] and all(r.doc_tokens == len(ids) for r in own)
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    crc = spark.createDataFrame(rows[:1]).select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(rows[0].ids)


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    settings = json.loads(open(WORDS, encoding="utf-8").read())
    settings["normalizer"]["normalizers"].pop(1)  # white space stays as it is
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings), encoding="utf-8")
    own, plain = word_tokens.WordEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not own.by_word and word_tokens.WordEncoder(WORDS).by_word
    for t, got in zip(HARD, own.encode(HARD), strict=True):
        assert np.frombuffer(got, own.dtype).tolist() == plain.encode(t or "", add_special_tokens=False).ids

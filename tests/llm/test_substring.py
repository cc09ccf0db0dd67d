"""Substring dedup and its index against brute force."""

import random
import re

import numpy as np
import pytest

from hustings.llm import fm_index, substring_dedup

random.seed(4)
VOCABULARY = [f"w{i}" for i in range(300)]


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 37, 500)
    tree = fm_index.WaveletTree(v, 36)
    value, place = rng.integers(0, 37, 900), rng.integers(0, 501, 900)
    assert tree.rank(value, place).tolist() == [int((v[:p] == x).sum()) for x, p in zip(value, place)]


@pytest.mark.parametrize("depth", [3, 6])
def test_matching_statistics(depth):
    rng = np.random.default_rng(depth)
    text = np.append(rng.integers(1, 6, 400), 0)
    text[[50, 120, 121, 300]] = 0
    index = fm_index.FMIndex(text, depth)
    joined = " ".join(map(str, text))
    queries = np.append(np.append(rng.integers(1, 8, 200), 0), text)
    ends = np.flatnonzero(queries == 0)
    length, group = index.matches(queries, ends, len(queries))
    for k in np.flatnonzero(queries > 0):
        stop = ends[np.searchsorted(ends, k)]
        want = 0
        while want < depth and k + want < stop and re.search(rf"\b{' '.join(map(str, queries[k : k + want + 1]))}\b", joined):
            want += 1
        assert length[k] == want, k
        assert (group[k] >= 0) == (want == depth)
        if want == depth:
            own = index.order[index.group == group[k]]
            assert all((text[o : o + depth] == queries[k : k + depth]).all() for o in own)
            assert len(own) == sum((text[o : o + depth] == queries[k : k + depth]).all() for o in range(len(text) - depth + 1))


def test_anchors_stand_for_each_window_once():
    rng = np.random.default_rng(7)
    sizes = np.array([0, 30, 9, 60, 1, 12, 100])
    words = rng.integers(0, 4, sizes.sum()).astype(np.uint64)
    place, value, first, last = substring_dedup.anchors(words, sizes, 12, gram=3)
    windows = sorted(p - o for p, f, z in zip(place.tolist(), first.tolist(), last.tolist()) for o in range(f, z + 1))
    base = np.cumsum(sizes) - sizes
    assert windows == [b + i for b, n in zip(base.tolist(), sizes.tolist()) for i in range(n - 11)]
    at = {p - o: (o, v) for p, f, z, v in zip(place.tolist(), first.tolist(), last.tolist(), value.tolist()) for o in range(f, z + 1)}
    by_words = {}
    for w, seen in at.items():
        assert by_words.setdefault(tuple(words[w : w + 12].tolist()), seen) == seen


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    oldest = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                oldest[key] = min(i, oldest.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if oldest[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus(window):
    passage, line = random.choices(VOCABULARY, k=2 * window), random.choices(VOCABULARY, k=window - 5)
    texts = [None, "", " \n", "short one", " ".join(["same"] * 400), " ".join(["same"] * 90), " ".join(["ab", "ba"] * 200)]
    for n in (window, window + 1, 3 * window, 400):
        base = random.choices(VOCABULARY, k=n)
        texts += [" ".join(base), "  ".join(base)]
        for _ in range(6):
            w = [random.choice(VOCABULARY) if random.random() < 0.01 else x for x in base]
            at = random.randrange(len(w) + 1)
            texts.append(" ".join(w[:at] + random.choice([passage, line, passage[:window], passage[3:]]) + w[at:]))
    for _ in range(40):
        texts.append(" ".join(random.choices(VOCABULARY, k=random.randrange(2 * window)) + passage + random.choices(VOCABULARY, k=random.randrange(2 * window))))
        texts.append("\n".join(" ".join(line) for _ in range(random.randrange(1, 6))) + "\x1c é ü")
    ids = random.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    return rows + [(None, texts[8]), (rows[9][0], texts[12]), rows[10]]


@pytest.mark.parametrize("window,crowd", [(50, 512), (12, 3), (12, 0)])
def test_removal(spark, window, crowd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)  # anchors of more contexts are split by window
    rows = corpus(window)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, start int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, window).collect())
    assert got == brute(rows, window)
    assert substring_dedup.remove_repeats(docs.limit(0), window).count() == 0


def test_word_hashes():
    from hustings.llm import shingles

    texts = [None, "", " \t", "a b  a", "x" * 600_000 + " y " + "x" * 600_000 + "z", "é\x1c ü b", "a b", *(" ".join(random.choices(VOCABULARY, k=60_000)) for _ in range(3))]
    words, sizes = shingles.hashed_words(texts)
    spelt = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert sizes.tolist() == [len(w) for w in spelt]
    known = {}
    for w, h in zip((x for s in spelt for x in s), words.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert shingles.hashed_words(["AÉ b"], lower=True)[0].tolist() == shingles.hashed_words(["aÉ", "B "], lower=True)[0].tolist()
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))  # collides with its complement under polynomials modulo 2^64
    both = shingles.hashed_words([word, word.translate(str.maketrans("ab", "ba"))])[0]
    assert both[0] != both[1]


def test_words_that_are_alike_but_not_equal(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    words = random.choices(VOCABULARY, k=61)
    rows = [(1, " ".join([*words[:30], word, *words[30:60]])), (2, " ".join([*words[:30], word.translate(str.maketrans("ab", "ba")), *words[30:60]])), (3, " ".join([*words[:30], word, *words[30:60]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == brute(rows, 50) and [r[2] for r in got] == [0, 0, 61]

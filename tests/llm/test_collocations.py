"""Collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from hustings.llm import collocations as c


def pieces(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(docs, least=10, longest=3, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, longest + 1):
                f.update((lang, tuple(p[i : i + k])) for i in range(len(p) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    held = Counter()
    for (lang, p), v in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held[lang, p[i : i + k]], v)
    rows = []
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * held[lang, p] < share * a:
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return out


def run(spark, docs, **kw):
    df = spark.createDataFrame([(t, g, 7) for t, g in docs], "text string, lang string, rank int").repartition(3)
    return [tuple(r) for r in c.collocations(df, **kw).orderBy("lang", "rank").collect()]


@pytest.mark.parametrize("longest, shard, seed", [(3, 2_000_000, 1), (3, 200, 2), (2, 50, 3), (4, 900, 4)])
def test_random_texts(spark, longest, shard, seed):
    rng = random.Random(seed)
    words = ["a", "B", "é", "東京", "a-b", "x" * 300, "z"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", "  ", ". ", ",", "\n", "\x0c"]) for _ in range(rng.choice([0, 1, 5, 200])))
    docs = [(rng.choice([text(), None, "", " .,"]) if rng.random() < 0.2 else text(), rng.choice(["en", "und", None, ""])) for _ in range(60)]
    docs += docs[:20]
    want = brute(docs, 3, longest)
    assert want and run(spark, docs, least=3, longest=longest, shard=shard) == want


def test_overlaps_edges_and_ties(spark):
    docs = [("a a a a a a a a a a a a", "x"), ("Q r. q R", None), ("q r", "und"), ("new york city " * 9 + "new york", "x")] * 2
    got = run(spark, docs, least=4)
    assert got == brute(docs, 4)
    assert ("x", "a a a", 20) in {(g, p, a) for g, _, p, a, *_ in got}
    assert all(p != "new york" for _, _, p, *_ in got)  # within "new york city" 18 times of 20
    assert run(spark, docs, least=4, top=2) == brute(docs, 4, top=2)


def test_empty(spark):
    assert run(spark, []) == run(spark, [(None, None), ("", "en"), ("one two", "en")]) == []


def test_bitmaps_cross_blocks_and_stop_at_gaps():
    rng = np.random.default_rng(5)
    sequence = rng.integers(0, 6, 4000).astype(np.int32)
    maps = c.Bitmaps(sequence)
    for bundle in (7, 1 << 18):
        got = {(p, w): n for p, w, n in zip(*(x.tolist() for x in c.grow(maps, 6, [], bundle)), strict=True)}
        want = Counter((a, b) for a, b in zip(sequence.tolist(), sequence[1:].tolist(), strict=False) if a and b)
        assert got == want

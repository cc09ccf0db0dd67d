"""The Jaccard join against all pairs."""

import random
import re

import pytest

from hustings.llm import jaccard_join

random.seed(11)
WORDS = [f"w{i}" for i in range(400)]


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def edited(words, rate):
    return " ".join(random.choice(WORDS) if random.random() < rate else w for w in words)


def corpus():
    common = random.choices(WORDS, k=40)
    texts = [None, "", " \t\n", "One two", "ONE  two", "one two three", "a b c d", "a b c d e", "É x y z", "é x y z", "x\x1cy z w", "ſ K A"]
    for n in (30, 60, 120):
        base = random.choices(WORDS, k=n)
        texts += [edited(base, rate) for rate in (0.0, 0.0, 0.01, 0.02, 0.03, 0.05) for _ in range(6)]
        texts += [" ".join(common + random.choices(WORDS, k=n)) for _ in range(15)]
    hot = random.choices(WORDS, k=80)
    texts += [edited(hot, 0.03) for _ in range(70)]
    texts += [" ".join(["same"] * n) for n in (4, 9, 300)] + [" ".join(random.choices(WORDS, k=20_000))]
    ids = random.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("k,percent,buckets", [(4, 85, 1 << 14), (5, 80, 1 << 14), (4, 85, 1 << 20)])
def test_links(spark, k, percent, buckets, monkeypatch):
    if buckets == 1 << 20:  # the hot group's shingles and runs are dealt out in parts, sketches joined in levels
        for name, value in (("RUN", 16), ("HEAVY", 8), ("SPREAD", 0), ("FAN", 2)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, token string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(docs, k, percent, buckets).collect())
    assert got == brute(rows, k, percent)
    if k == 5:
        kept = jaccard_join.deduplicate(docs, k, percent, buckets)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in got if i == c)


def test_many_small_groups_share_a_run(spark):
    """Far copies of one text: nearly all hold its shingles, few are near enough to another; pairs are few all the same."""
    from hustings.workers import temporary

    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in random.sample(range(150), random.choice((1, 4, 5, 6))):
            words[at] = f"u{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    later = jaccard_join._later_pairs

    def spied(percent):
        run = later(percent)

        def counting(batches):
            for b in run(batches):
                counter.add(b.num_rows)
                yield b

        return counting

    counter = spark.sparkContext.accumulator(0)
    jaccard_join._later_pairs = spied
    try:
        with temporary(spark):
            got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(docs).collect())
    finally:
        jaccard_join._later_pairs = later
    assert got == brute(rows, 4, 85) and len({c for _, _, c in got}) > 200
    assert counter.value < 5 * len(rows), counter.value


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "p q r s"), (7, "p q r s"), (5, "a b c d"), (9, "a B c D"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.link(docs, buckets=1 << 14).collect())
    assert got == [(-1, 0, -1), (-1, 1, -1), (5, 1, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 1, 5)]
    assert jaccard_join.link(docs.limit(0), buckets=1 << 14).count() == 0 and jaccard_join.deduplicate(docs.limit(0), buckets=1 << 14).count() == 0


def test_lengths():
    for n in range(1, 300):
        for percent in (80, 85):
            p = jaccard_join.prefix_length(n, percent)
            need = min(x for x in range(n + 1) if 100 * x >= percent * n)
            assert p == n - need + 1
            for m in (n, n + 3, 2 * n):
                o = jaccard_join.least_overlap(n, m, percent)
                assert 100 * o >= percent * (n + m - o) and 100 * (o - 1) < percent * (n + m - o + 1)


def twins(n=1024):
    """Two words that collide under any polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_are_alike_but_not_equal(spark):
    one, other = twins()
    rows = [(1, one), (2, other), (3, one.upper()), (4, f"x {one} y z"), (5, f"x {other} y z"), (6, f"{one} {other} " * 40), (7, f"{other} {one} " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.link(docs).collect()) == brute(rows, 4, 85)


def test_small_components_in_runs_dealt_out_in_parts(spark, monkeypatch):
    """Many groups of two that share common shingles, and one large group: pairs meet once, whatever parts they lie in."""
    for name, value in (("RUN", 8), ("HEAVY", 8), ("SPREAD", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    common = [f"c{i}" for i in range(50)]
    rows = []
    for g in range(40):
        tail = [f"t{g}_{i}" for i in range(11 + g % 5)]
        rows += [(2 * g, " ".join(common + tail)), (2 * g + 1, " ".join(common + tail + [f"e{g}"]))]
    rows += [(1000 + i, " ".join([*common, *(f"m{j}" for j in range(9)), f"v{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 70):
        assert sorted(tuple(r) for r in jaccard_join.link(docs, percent=percent).collect()) == brute(rows, 4, percent)

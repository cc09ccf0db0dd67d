"""Source mixes: targets against plain Python, and what a mix must keep."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from hustings.llm import mixing as m


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(docs, weights=(3, 1, 2), percent=150, most=2):
    """Exact targets by source, shared in turns as the definition says."""
    z = defaultdict(int)
    for _, text, source in docs:
        z[source] += size(text)
    order = sorted(z, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, done = Fraction(percent * sum(z.values()), 100), {}
    while True:
        free = [s for s in order if s not in done]
        share = {s: (budget - sum(done.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * z[s]]
        if not over:
            return dict(z), done | share
        done |= {s: Fraction(most * z[s]) for s in over}


def run(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, copies int").repartition(4)
    return [r.asDict() for r in m.mix(df, **kw).collect()]


def check(docs, rows, most=2, **kw):
    z, want = goals(docs, most=most, **kw)
    key = lambda i, n, s: (str(i), n, str(s), s is None)
    assert Counter(key(r["doc_id"], r["size"], r["source"]) for r in rows) == Counter(key(i, size(t), s) for i, t, s in docs)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == z[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= most
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) * 2 <= largest[s]


def some(n, seed, sources=("a", "B", "é", "", None, "z", "hot")):
    rng = random.Random(seed)
    weights = [1, 2, 1, 1, 3, 1, 12]
    return [(rng.choice([i, i // 2, None]), rng.choice([None, ""]) if rng.random() < 0.05 else "w " * int(rng.paretovariate(0.8) + 1), s) for i, s in enumerate(rng.choices(sources, weights, k=n))]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_takes(spark, seed):
    docs = some(400, seed)
    rows = run(spark, docs)
    check(docs, rows)
    again = run(spark, docs[::-1])
    digest = lambda out: sorted(tuple(map(str, r.values())) for r in out)
    assert digest(rows) == digest(again)


def test_other_weights(spark):
    docs = some(200, 5)
    check(docs, run(spark, docs, weights=(1, 5), percent=260, most=3), weights=(1, 5), percent=260, most=3)


def test_rows_that_are_alike(spark):
    docs = [(1, "a b c", "x")] * 300 + [(None, "d", "y")] * 50 + [(2, "e " * 400, None)]
    check(docs, run(spark, docs))


def test_larger_targets_only_add(spark):
    docs = [(i, "w " * (1 + i % 7), s) for i in range(300) for s in ("p", "q")]
    by = lambda rows: {(r["doc_id"], r["source"]): r["copies"] for r in rows}
    less, more = by(run(spark, docs, percent=60)), by(run(spark, docs, percent=120))
    assert all(more[k] >= n for k, n in less.items()) and more != less


def test_empty_and_sizeless(spark):
    assert run(spark, []) == []
    rows = run(spark, [(1, None, "a"), (2, "", None)])
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_many_sources_are_ranked_over_ranges(spark):
    docs = [(i, "w " * (1 + i * 7919 % 50), f"s{i:04d}" if i % 97 else None) for i in range(500)]
    check(docs, run(spark, docs))


def test_native(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    assert not re.search("Python|Pandas|Arrow", m.mix(df)._jdf.queryExecution().toString())

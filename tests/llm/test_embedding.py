"""Embedding near-dedup and components against brute force."""

import random

import numpy as np
import pytest

from hustings.llm import components, embedding_dedup

rng = np.random.default_rng(3)


def brute(rows, threshold=0.9):
    ok = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, x in rows]
    n = len(rows)
    links, label = [0] * n, list(range(n))
    u = [np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)) if o else None for (_, x), o in zip(rows, ok)]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return sorted((no_null(r[0]), links[i], no_null(least.get(root(i)))) for i, r in enumerate(rows))


def no_null(x):
    return -1 if x is None else x


def test_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (None, None), (None, [-1.0, 0.0]), (None, [-1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((no_null(r.vec_id), r.n_links, no_null(r.component_id)) for r in got) == brute(rows)
    assert (5, 2, 3) in [(r.vec_id, r.n_links, r.component_id) for r in got] and all(r.kept == (r.vec_id == r.component_id) for r in got)
    mixed = [(random.choice([None, 1, 2, 3]), [float(x) for x in rng.integers(-2, 3, 3)]) for _ in range(120)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), tile=16).collect()
    assert sorted((no_null(r.vec_id), r.n_links, no_null(r.component_id)) for r in got) == brute(mixed)


def test_near_duplicates(spark):
    base = rng.normal(size=(12, 16))
    rows = [(int(k), [float(v) for v in base[k % 12] + rng.normal(size=16) * (0.1 + 0.05 * (k % 7))]) for k in rng.permutation(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(40)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [v * 3 for v in rows[7][1]])]
    table = spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, kept string")
    for pivots, tile in ((8, 32), (1, 1000)):
        got = embedding_dedup.near_duplicates(table, pivots=pivots, tile=tile).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_bounds_hold():
    u = embedding_dedup.unit(rng.normal(size=(400, 24)) * rng.lognormal(size=(400, 24)))
    q, s, long_q, e = embedding_dedup.quantised(u)
    near = (q.astype(float) @ q.astype(float).T) * np.outer(s, s)
    bound = np.outer(long_q, e) + np.outer(e, long_q) + np.outer(e, e)
    assert (np.abs(u @ u.T - near) <= bound).all()
    i, j = embedding_dedup.linked(u, u, 0.5, True)
    assert {*zip(i.tolist(), j.tolist())} == {(a, b) for a in range(400) for b in range(a + 1, 400) if u[a] @ u[b] >= 0.5}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, kind):
    random.seed(2)
    edges = {"chain": [(i, i + 1) for i in range(60)], "random": [(random.randrange(90), random.randrange(90)) for _ in range(60)], "star": [(7, i) for i in range(50)], "none": []}[kind]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}
    if edges:
        a, b = np.array(edges).T
        assert all(components.spanning(a, b, 100)[k] == v for k, v in label.items())


def test_doubles_are_not_rounded(spark):
    """0.9 within rounding of floats: the double cosine decides."""
    b = [0.9 - 1e-9, (1 - (0.9 - 1e-9) ** 2) ** 0.5]
    c = [0.9 + 1e-9, -((1 - (0.9 + 1e-9) ** 2) ** 0.5)]
    rows = [(1, [1.0, 0.0]), (2, b), (3, c)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (0, 2), 3: (1, 1)}

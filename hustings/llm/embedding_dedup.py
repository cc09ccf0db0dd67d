"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors (by 128 bits of hash) are counted once, with a weight, and numbered; ids only label the result. Each distinct vector, scaled to length one (u), becomes q, int8, and a scale s;
e = |u - s*q| is kept exactly. For two vectors |u.v - s*t*(q.r)| <= |s*q|*f + e*|t*r| + e*f, so a tile product of int8
values decides nearly all pairs: surely below the threshold, or surely above it; the rest, the pairs possibly above it, are
computed again in double precision. (Tiles multiply as float32, in which products of int8 vectors of up to 1040 parts are
exact; longer ones multiply as float64.)

Vectors lie in cells around up to `pivots` vectors, a bounded sample that grows with the rows; cells are cut into tiles of about `tile` rows by a hash. A pair
of cells is left out only if the angle between their centres less both radii is over the threshold's angle, so no link is
lost. Tiles are dealt out in squares of SIDE by SIDE, so a task gets each tile once for SIDE products. A tile pair gives each
vector's weighted number of links and a spanning set of its links, never all pairs.

Null vectors, zero vectors and those with null or non-finite parts link with nothing; so do vectors of different lengths.
Repeated rows, and rows that share an id, are vectors of their own. A row of a null id counts as a vector for the others, but
names no component: a component of such rows alone has a null component_id, and all of them are kept. An empty table gives an
empty result. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.components import components, spanning
from hustings.workers import importable, temporary, written

THRESHOLD, PIVOTS, TILE, SIDE = 0.9, 1024, 4096, 4
#: Above all rounding of double arithmetic here.
EPS = 1e-11


def unit(x: np.ndarray) -> np.ndarray:
    """Rows, scaled to length one in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q (int8), scale, length of scale * q, length of what is left."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1) + EPS, np.linalg.norm(u - back, axis=1) + EPS


def linked(u: np.ndarray, v: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of u and v with cosine at or over the threshold; only i < j if they are the same tile."""
    q, s, long_q, e = quantised(u)
    r, t, long_r, f = quantised(v)
    kind = np.float32 if u.shape[1] <= 1040 else np.float64
    out_i, out_j = [], []
    right = np.ascontiguousarray(r.astype(kind).T)
    for at in range(0, len(q), 512):
        rows = slice(at, at + 512)
        near = (q[rows].astype(kind) @ right).astype(np.float64) * s[rows, None] * t
        bound = long_q[rows, None] * f + e[rows, None] * (long_r + f) + EPS
        i, j = np.nonzero(near + bound >= threshold)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        unsure = near[i, j] - bound[i, j] < threshold
        for k in range(0, len(i), 1 << 17):
            part = np.flatnonzero(unsure[k : k + (1 << 17)]) + k
            cosine = np.einsum("ij,ij->i", u[i[part] + at], v[j[part]])
            unsure[part] = cosine < threshold
        out_i.append(i[~unsure] + at)
        out_j.append(j[~unsure])
    return np.concatenate(out_i) if out_i else np.zeros(0, int), np.concatenate(out_j) if out_j else np.zeros(0, int)


def _payload(ids: np.ndarray, weight: np.ndarray, x: np.ndarray) -> bytes:
    return np.array([len(ids), x.shape[1], x.itemsize], "<i8").tobytes() + ids.astype("<i8").tobytes() + weight.astype("<i8").tobytes() + x.tobytes()


def _opened(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d, size = np.frombuffer(b, "<i8", 3)
    return np.frombuffer(b, "<i8", n, 24), np.frombuffer(b, "<i8", n, 24 + 8 * n), np.frombuffer(b, f"<f{size}", n * d, 24 + 16 * n).reshape(n, d)


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    importable(table.sparkSession)
    kind = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # doubles stay what they are
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    with temporary(table.sparkSession) as keep:
        return keep(written(_labelled(rows, threshold, pivots, tile), "near-duplicates"))


def _labelled(rows: DataFrame, threshold: float, pivots: int, tile: int) -> DataFrame:
    """The result, from intermediate tables that it still needs."""
    fine = F.coalesce((F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    good = rows.filter(fine).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    distinct = good.groupBy("h1", "h2").agg(F.first("x").alias("x"), F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")  # numbers are fixed once written
    found = written(_linked(distinct.select("node", "weight", "x"), threshold, pivots, tile), "links")

    labels = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.select("h1", "h2", "node", "least_id", "weight").join(links, "node", "left").join(labels, "node", "left")
    named = known.filter("component IS NOT NULL").groupBy("component").agg(F.min("least_id").alias("named"))
    known = known.join(named, "component", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("named", "least_id").alias("component_id"))
    linked_rows = good.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(distinct: DataFrame, threshold: float, pivots: int, tile: int) -> DataFrame:
    """Of numbered vectors: node, links (weighted, in one tile pair), least (a node that it is linked to or itself)."""
    spark = distinct.sparkSession
    cells_wanted = max(1, min(pivots, distinct.count() // (2 * tile)))  # cells of two tiles or more: each tile is sent to all tiles near it
    chosen = distinct.withColumn("d", F.size("x")).orderBy(F.xxhash64("node"), "node").limit(cells_wanted).collect()
    centres = {d: unit(np.array([r.x for r in chosen if r.d == d])) for d in {r.d for r in chosen}}

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["x"].map(len)
            cell = pd.Series(0, pdf.index)
            angle = pd.Series(math.pi, pdf.index)
            for d, at in size.groupby(size).groups.items():
                if d in centres:
                    near = unit(np.stack(pdf.loc[at, "x"].to_numpy())) @ centres[d].T
                    cell[at] = near.argmax(1)
                    angle[at] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pd.DataFrame({"node": pdf["node"], "weight": pdf["weight"], "x": pdf["x"], "d": size, "cell": cell, "angle": angle})

    cells = written(distinct.mapInPandas(celled, f"node long, weight long, x {distinct.schema['x'].dataType.simpleString()}, d int, cell int, angle double"), "cells")
    # a row for each dimension and cell: `pivots` rows, and one for each vector length without a pivot
    held = cells.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    tiled = cells.join(held, ["d", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile)).cast("int"))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [key[0]], "cell": [key[1]], "chunk": [key[2]], "tile": [_payload(pdf["node"].to_numpy(), pdf["weight"].to_numpy(), np.stack(pdf["x"].to_numpy()))]})

    tiles = written(tiled.groupBy("d", "cell", "chunk").applyInPandas(packed, "d int, cell int, chunk int, tile binary"), "tiles")
    far = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    close = []
    radii = held.filter(F.col("d").isin(list(centres))).collect() if centres else []  # a row a pivot at most
    for d, c in centres.items():
        found = {r.cell: r.radius for r in radii if r.d == d}
        at = np.array(sorted(found))
        radius = np.array([found[k] for k in sorted(found)])
        if len(at):
            between = np.arccos(np.clip(c[at] @ c[at].T, -1, 1)) - radius[:, None] - radius
            close += [(int(d), int(at[i]), int(at[j])) for i, j in zip(*np.nonzero(np.triu(between <= far)), strict=True)]
    pairs = spark.createDataFrame(close, "d int, cell int, other int")
    rest = held.filter(~F.col("d").isin(list(centres))).select("d", "cell", F.col("cell").alias("other"))
    pairs = pairs.unionByName(rest)

    tiles = tiles.withColumn("strip", F.floor(F.col("chunk") / SIDE).cast("int"))
    strips = tiles.select("d", "cell", "strip").distinct()
    squares = strips.join(pairs, ["d", "cell"]).join(strips.select("d", F.col("cell").alias("other"), F.col("strip").alias("strip2")), ["d", "other"]).filter("cell < other OR strip <= strip2")
    square = ["d", "cell", "strip", "other", "strip2"]
    left = squares.join(tiles, ["d", "cell", "strip"]).select(*square, F.lit(0).alias("side"), "chunk", "tile")
    right = squares.filter("cell < other OR strip < strip2").join(tiles.select("d", F.col("cell").alias("other"), F.col("strip").alias("strip2"), "chunk", "tile"), ["d", "other", "strip2"])
    sent = left.unionByName(right.select(*square, F.lit(1).alias("side"), "chunk", "tile"))

    def multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [[_opened(b) for b in pdf.loc[pdf["side"] == k].sort_values("chunk")["tile"]] for k in (0, 1)]
        one = [(ids, weight, unit(x)) for ids, weight, x in sides[0]]
        two = [(ids, weight, unit(x)) for ids, weight, x in sides[1]]
        both = [(a, b, False) for a in one for b in two] if two else [(a, b, i == j) for i, a in enumerate(one) for j, b in enumerate(one) if i <= j]
        out = [got for a, b, same in both if (got := _tile_links(a, b, same, threshold)) is not None]
        columns = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame(dict(zip(("node", "links", "least"), columns, strict=True)))

    return sent.groupBy(*square).applyInPandas(multiplied, "node long, links long, least long")


def _tile_links(a: tuple, b: tuple, same: bool, threshold: float) -> np.ndarray | None:
    """Rows of node, weighted links and least node reachable, of two tiles (or of one and itself)."""
    ids, weight, u = a
    ids2, weight2, v = b
    i, j = linked(u, v, threshold, same)
    if not len(i):
        return None
    every = ids if same else np.concatenate([ids, ids2])
    shift = 0 if same else len(ids)
    count = np.bincount(i, weight2[j], len(every)) + np.bincount(j + shift, weight[i], len(every))
    order = np.argsort(every)
    place = np.empty(len(every), int)
    place[order] = np.arange(len(every))
    least = every[order][spanning(place[i], place[j + shift], len(every))[place]]
    on = np.flatnonzero(count)
    return np.stack([every[on], count[on].astype(np.int64), least[on]])

"""Rings as array<struct<x, y>>: centres, areas, boxes, and which polygon holds a point. All in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring vertices, the last with the first."""
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, (i + 1) % F.size(ring))["x"].alias("bx"), F.get(ring, (i + 1) % F.size(ring))["y"].alias("by")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def vertex_mean(ring: Column) -> Column:
    """struct<x, y>: the mean of the vertices."""
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def largest(rings: Column) -> Column:
    """The ring of largest area; of equal ones the first."""
    sized = F.transform(rings, lambda r, i: F.struct((-F.abs(signed_area(r))).alias("a"), i.alias("i"), r.alias("r")))
    return F.array_min(sized)["r"]


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: whether a ray to the right crosses the ring an odd number of times."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def located(points: DataFrame, polygons: DataFrame, x: str, y: str, key: str, ring: str, cell: float) -> DataFrame:
    """points with the least key of the polygons that hold each (null: none).

    Polygons are dealt to the grid cells of their boxes, a list a cell, and points to their own cell, so the join is on cells and each
    point stays one row; the exact test follows.
    """
    low = lambda c: F.floor(F.array_min(F.transform(ring, lambda p: p[c])) / cell)
    high = lambda c: F.floor(F.array_max(F.transform(ring, lambda p: p[c])) / cell)
    boxes = polygons.select(F.col(key).alias("__key"), F.col(ring).alias("__ring"), F.explode(F.sequence(low("x"), high("x"))).alias("__cx"), F.sequence(low("y"), high("y")).alias("__ys"))
    boxes = boxes.select("__key", "__ring", "__cx", F.explode("__ys").alias("__cy"))
    listed = boxes.groupBy("__cx", "__cy").agg(F.collect_list(F.struct(F.col("__key").alias("k"), F.col("__ring").alias("r"))).alias("__zones"))
    own = points.withColumn("__cx", F.floor(F.col(x) / cell)).withColumn("__cy", F.floor(F.col(y) / cell)).join(listed, ["__cx", "__cy"], "left")
    holding = F.filter("__zones", lambda z: inside(z["r"], F.col(x), F.col(y)))
    return own.select(*points.columns, F.array_min(F.transform(holding, lambda z: z["k"])).alias(key))

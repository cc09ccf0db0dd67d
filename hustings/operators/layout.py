"""Hexagonal grids, adjacency, and words of a page by place."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from hustings.operators.graph import components
from hustings.operators.ranges import numbered
from hustings.operators.turns import in_turn
from hustings.workers import temporary, written

#: Neighbours in odd-r offset coordinates, for even and odd rows: (column, row) steps.
EVEN = ((1, 0), (-1, 0), (0, -1), (-1, -1), (0, 1), (-1, 1))
ODD = ((1, 0), (-1, 0), (0, -1), (1, -1), (0, 1), (1, 1))


def neighbours(cells: DataFrame, c: str = "c", r: str = "r") -> DataFrame:
    """Six rows a cell, with nc and nr."""
    steps = lambda s: F.array(*[F.struct(F.lit(a).alias("dc"), F.lit(b).alias("dr")) for a, b in s])
    out = cells.withColumn("__s", F.explode(F.when(F.pmod(F.col(r), F.lit(2)) == 0, steps(EVEN)).otherwise(steps(ODD))))
    return out.withColumn("nc", F.col(c) + F.col("__s.dc")).withColumn("nr", F.col(r) + F.col("__s.dr")).drop("__s")


def hex_distance(c1: Column, r1: Column, c2: Column, r2: Column) -> Column:
    """Steps between two cells, through cube coordinates."""
    x = lambda c, r: c - (r - F.pmod(r, F.lit(2))) / 2
    dx, dz = x(c1, r1) - x(c2, r2), r1 - r2
    return ((F.abs(dx) + F.abs(dz) + F.abs(dx + dz)) / 2).cast("long")


def pixel(c: Column, r: Column, size: float) -> tuple[Column, Column]:
    """Centre of a cell with corners `size` from it."""
    return size * 3**0.5 * (c + 0.5 * F.pmod(r, F.lit(2))), size * 1.5 * r


def adjacency(cells: DataFrame, key: str, c: str = "c", r: str = "r") -> DataFrame:
    """Distinct pairs a < b of keys with touching cells."""
    own = cells.select(F.col(c).alias("nc"), F.col(r).alias("nr"), F.col(key).alias("b"))
    return neighbours(cells, c, r).join(own, ["nc", "nr"]).filter(F.col(key) < F.col("b")).select(F.col(key).alias("a"), "b").distinct()


def borders(cells: DataFrame, group: str, c: str = "c", r: str = "r") -> DataFrame:
    """Sides of cells whose neighbour lies in another group or nowhere."""
    own = cells.select(F.col(c).alias("nc"), F.col(r).alias("nr"), F.col(group).alias("__g"))
    return neighbours(cells, c, r).join(own, ["nc", "nr"], "left").filter(~F.col(group).eqNullSafe(F.col("__g"))).select(c, r, "nc", "nr", group, F.col("__g").alias("other"))


def holes(cells: DataFrame, least: int = 4, c: str = "c", r: str = "r") -> DataFrame:
    """Free places with `least` neighbours or more."""
    own = cells.select(F.col(c).alias("nc"), F.col(r).alias("nr"))
    return neighbours(cells, c, r).select("nc", "nr").join(own, ["nc", "nr"], "left_anti").groupBy("nc", "nr").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def agreement(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of a set of keys; 0 where they have no base."""
    f, t = found.select(*keys).distinct().withColumn("__f", F.lit(1)), truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    n = f.join(t, keys, "full").agg(F.count("__f").alias("f"), F.count("__t").alias("t"), F.count_if(F.col("__f").isNotNull() & F.col("__t").isNotNull()).alias("both"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return n.select("both", safe(F.col("both"), F.col("f")).alias("precision"), safe(F.col("both"), F.col("t")).alias("recall"), safe(2 * F.col("both"), F.col("f") + F.col("t")).alias("f1"))


def grid_components(cells: DataFrame, group: str, c: str = "c", r: str = "r") -> DataFrame:
    """(group, c, r, component): cells of one group that touch; component is the least of c * 10^6 + r among them, unique within a group.

    Distinct cells are numbered nodes. Cells without a place are on their own, with a null component. Repeated rows stay.
    """
    rows = written(cells.select(group, c, r), "cells")
    placed = rows.filter(F.col(c).isNotNull() & F.col(r).isNotNull())
    nodes = written(placed.distinct().withColumn("__node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    own = nodes.select(F.col(c).alias("nc"), F.col(r).alias("nr"), F.col(group).alias("__g"), F.col("__node").alias("b"))
    edges = neighbours(nodes, c, r).join(own, ["nc", "nr"]).filter(F.col(group).eqNullSafe(F.col("__g"))).select(F.col("__node").alias("a"), "b")
    labels = nodes.join(components(edges).withColumnRenamed("node", "__node"), "__node", "left").withColumn("__label", F.coalesce("component", "__node"))
    least = labels.groupBy("__label").agg(F.min(F.col(c).cast("long") * 1_000_000 + F.col(r)).alias("component"))
    named = labels.drop("component").join(least, "__label").select(F.col(group).alias("__g"), F.col(c).alias("__c"), F.col(r).alias("__r"), "component")
    same = (F.col(c) == F.col("__c")) & (F.col(r) == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g"))
    return rows.join(named, same, "left").select(group, c, r, "component")


def lines(words: DataFrame, page: list[str], y: str, gap: float, pos: list[str]) -> DataFrame:
    """Adds line, from 1: words by y stay on a line while the gap to the word before is at most `gap`."""
    w = Window.partitionBy(*page).orderBy(y, *pos)
    return words.withColumn("__new", F.coalesce(F.col(y) - F.lag(y).over(w) > gap, F.lit(True)).cast("int")).withColumn("line", F.sum("__new").over(w)).drop("__new")


def anchored(
    words: DataFrame, anchors: DataFrame, page: list[str], x: str, anchor: str, most: float, pos: tuple[str, ...] | list[str] = (), avoid: DataFrame | None = None, apart: float = 14.0
) -> DataFrame:
    """words with the nearest anchor of their page within `most`, the lower of two as near (so pos settles nothing); null if there is none.

    Words nearer than `apart` to an anchor of `avoid` (columns of pages, and anchor) belong to none. Anchors of a page are few: they form one list, and
    each word stays one row.
    """
    list_of = lambda df, name: df.groupBy(*page).agg(F.collect_set(F.col(anchor)).alias(name))
    near = F.filter(F.transform("__anchors", lambda a: F.struct(F.abs(F.col(x) - a).alias("d"), a.alias("a"))), lambda s: s["d"] <= most)
    listed = words.join(list_of(anchors, "__anchors"), page, "left")
    if avoid is None:
        return listed.select(*words.columns, F.array_min(near)["a"].alias("anchor"))
    listed = listed.join(list_of(avoid, "__avoid"), page, "left")
    beside = F.coalesce(F.exists("__avoid", lambda a: F.abs(F.col(x) - a) < apart), F.lit(False))
    return listed.select(*words.columns, F.when(~beside, F.array_min(near)["a"]).alias("anchor"))


def _rank_correlation(df: DataFrame, x: str, y: str, pos: str, name: str) -> DataFrame:
    """(measure, value): the correlation of ordinal ranks, ties by pos; 0 where there is none. Ranks come from ranges, not from one sorted task."""
    ranked = numbered(numbered(df.select(x, y, pos), [F.col(x), F.col(pos)], "__x"), [F.col(y), F.col(pos)], "__y")
    return ranked.agg(F.coalesce(F.nanvl(F.corr("__x", "__y"), F.lit(0.0)), F.lit(0.0)).alias("value")).select(F.lit(name).alias("measure"), "value")


#: Points that each measure of a layout can earn, 120 in all.
POINTS = {"connected": 30, "group_adjacency": 15, "group_order": 10, "adjacency": 25, "order": 10, "holes": 10, "pairs": 10, "tests": 10}


def layout_score(cells: DataFrame, truth: DataFrame, key: str, group: str, x: str, y: str, tests: DataFrame | None = None, c: str = "c", r: str = "r") -> DataFrame:
    """(measure, points) of a grid layout against a map, and their `total`, of 120 at most; points are whole, cut down.

    cells: key, group, c, r and the unit's place on the map (x to the east, y to the north); truth: pairs (a < b) of neighbours on the map. Measures: all groups
    connected; adjacency of groups and of units (F1); ranks of groups' and units' places, east to west and north to south, on the map and on the
    grid; free cells among four or more others; neighbours that keep their order; and tests: rows (a, b, axis) that say that a lies before b on axis `c` or `r`.
    """
    with temporary(cells.sparkSession) as keep:
        u = written(cells.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(c).alias("c"), F.col(r).alias("r"), F.col(x).alias("x"), F.col(y).alias("y")), "units")
        u2 = lambda s: u.select(*[F.col(n).alias(n + s) for n in ("k", "g", "c", "r", "x", "y")])
        parts = grid_components(u, "g").groupBy("g").agg(F.count_distinct("component").alias("n"))
        rows = [parts.agg(F.when(F.count_if(F.col("n") > 1) == 0, 1.0).otherwise(0.0).alias("value")).select(F.lit("connected").alias("measure"), "value")]

        place = u.withColumns({"gx": F.col("c") + F.pmod(F.col("r"), F.lit(2)) * 0.5, "gy": F.col("r") * (3**0.5 / 2)})
        of_groups = truth.join(u2("a"), F.col("a") == F.col("ka")).join(u2("b"), F.col("b") == F.col("kb")).filter("ga <> gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
        beside = adjacency(u, "k")
        beside_groups = beside.join(u2("a"), F.col("a") == F.col("ka")).join(u2("b"), F.col("b") == F.col("kb")).filter("ga <> gb").select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
        score = lambda found, true, name: agreement(found, true, ["a", "b"]).select(F.lit(name).alias("measure"), F.col("f1").cast("double").alias("value"))
        rows += [score(beside_groups, of_groups, "group_adjacency"), score(beside, truth, "adjacency")]
        means = written(place.groupBy("g").agg(*[F.avg(n).alias(n) for n in ("x", "y", "gx", "gy")]), "means")
        for name, t, pos in (("group_order", means, "g"), ("order", place, "k")):
            both = _rank_correlation(t, "x", "gx", pos, "x").union(_rank_correlation(t, "y", "gy", pos, "y"))
            kept = F.greatest(F.lit(0.0), F.when(F.col("measure") == "x", F.col("value")).otherwise(-F.col("value")))
            rows.append(both.agg((F.sum(kept) / 2).alias("value")).select(F.lit(name).alias("measure"), "value"))
        rows.append(holes(u, 4).agg((F.greatest(F.lit(0), 10 - F.count("*")) / 10).cast("double").alias("value")).select(F.lit("holes").alias("measure"), "value"))
        pairs = truth.join(u2("a"), F.col("a") == F.col("ka")).join(u2("b"), F.col("b") == F.col("kb"))
        same = ((F.col("xa") > F.col("xb")) == (F.col("ca") > F.col("cb"))).cast("int") + ((F.col("ya") > F.col("yb")) == (F.col("ra") < F.col("rb"))).cast("int")
        rows.append(pairs.agg(F.coalesce(F.sum(same) / (2 * F.count("*")), F.lit(0.0)).cast("double").alias("value")).select(F.lit("pairs").alias("measure"), "value"))
        if tests is not None:
            t = tests.join(u2("1"), F.col("a") == F.col("k1")).join(u2("2"), F.col("b") == F.col("k2"))
            holds = F.when(F.col("axis") == "c", F.col("c1") < F.col("c2")).otherwise(F.col("r1") < F.col("r2"))
            rows.append(t.agg(F.coalesce(F.count_if(holds) / F.count("*"), F.lit(0.0)).cast("double").alias("value")).select(F.lit("tests").alias("measure"), "value"))
        every = reduce(DataFrame.unionByName, rows)
        worth = F.coalesce(*[F.when(F.col("measure") == n, p) for n, p in POINTS.items()])
        points = written(every.select("measure", F.floor(F.col("value") * worth).cast("long").alias("points")), "points")
        return keep(written(points.union(points.agg(F.lit("total"), F.sum("points"))), "score"))


#: Pairs of a page's labels and numbers that are served within a row.
MOST_PAIRS = 100_000


def greedy_alignment(labels: DataFrame, numbers: DataFrame, page: list[str], x: str, label: str, value: str) -> DataFrame:
    """Labels, left to right, each take the nearest number of their page that no earlier label took, the left one of two as near: (page, label, value).

    Pages of at most MOST_PAIRS pairs are two lists in a row, served one label after the other; larger ones take turns in rounds, over tables of pairs.
    """
    with temporary(labels.sparkSession) as keep:
        left = labels.select(*page, F.col(x).cast("double").alias("at"), F.col(label).alias("label")).filter("at IS NOT NULL")
        right = numbers.select(*page, F.col(x).cast("double").alias("x"), F.col(value).cast("double").alias("v")).filter("x IS NOT NULL")
        left = written(left.withColumn("agent", F.monotonically_increasing_id()), "labels")
        right = written(right.withColumn("item", F.monotonically_increasing_id()), "numbers")
        pairs = left.groupBy(*page).agg(F.count("*").alias("n")).join(right.groupBy(*page).agg(F.count("*").alias("m")), page)
        sizes = written(pairs.select(*page, (F.col("n").cast("double") * F.col("m") <= MOST_PAIRS).alias("small")), "sizes")
        small, large = sizes.filter("small").select(*page), sizes.filter("NOT small").select(*page)

        asks = left.join(small, page).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("at", "label", "agent"))).alias("asks"))
        free = right.join(small, page).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("x", "v", "item"))).alias("free"))
        taken = F.filter("free", lambda f: F.lit(False))

        def serve(state: Column, ask: Column) -> Column:
            best = F.array_min(F.transform(F.array_except(F.col("free"), state), lambda f: F.struct(F.abs(f["x"] - ask["at"]).alias("d"), f["x"].alias("x"), f["v"].alias("v"), f["item"].alias("item"))))
            return F.when(F.size(state) < F.size("free"), F.array_append(state, F.struct(best["x"].alias("x"), best["v"].alias("v"), best["item"].alias("item")))).otherwise(state)

        served = asks.join(free, page).select(*page, "asks", F.aggregate("asks", taken, serve).alias("taken"))
        out = served.select(*page, F.inline(F.arrays_zip("asks", F.col("taken")))).filter("taken IS NOT NULL").select(*page, F.col("asks.label").alias(label), F.col("taken.v").alias(value))
        if not large.isEmpty():
            near = left.join(large, page).join(right, page)
            wishes = near.select(*page, "agent", F.struct("at", "label", "agent").alias("rank"), "item", F.struct(F.abs(F.col("x") - F.col("at")).alias("d"), "x", "v", "item").alias("place"))
            turns = in_turn(wishes, page, "agent", "rank", "item", "place")
            named = turns.join(left.select("agent", F.col("label").alias("__l")), "agent").join(right.select("item", "v"), "item")
            out = out.unionByName(named.select(*page, F.col("__l").alias(label), F.col("v").alias(value)))
        return keep(written(out, "aligned"))


def lanes(intervals: DataFrame, group: list[str], start: str, end: str, pos: str) -> DataFrame:
    """Adds lane: intervals by start, then pos, take the first lane that is free (its last end at or before their start). Null starts come last and find no
    free lane, null ends free none.

    Sequential within a group: tasks read sorted rows as a stream and keep no more than the lanes of the group they are in.
    """
    schema = StructType([*intervals.schema.fields]).add("lane", LongType())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, free, busy = None, 0, [], []
        for b in batches:
            lane = []
            for *key, at, to in zip(*(b.column(c).to_pylist() for c in (*group, start, end)), strict=True):
                if key != last:
                    last, count, free, busy = key, 0, [], []
                while at is not None and busy and busy[0][0] <= at:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if at is not None and free:
                    k = heapq.heappop(free)
                else:
                    k, count = count, count + 1
                if to is not None:
                    heapq.heappush(busy, (to, k))
                lane.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lane, pa.int64())], names=schema.names)

    ordered = intervals.repartition(*group).sortWithinPartitions(*group, F.col(start).asc_nulls_last(), F.col(pos).asc_nulls_last())
    return ordered.mapInArrow(place, schema)

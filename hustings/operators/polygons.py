"""Polygons as tables of directed edges: shared borders, dissolved outlines, coasts, simplified lines, contacts, and parts that join neighbours.

Polygons are rows (key, ring), a ring being array<struct<x, y>> without the first vertex repeated at its end; several rows of a key are its parts, and
holes are rings of the other sense of rotation. Neighbours share the vertices of their common border, as they do in maps cut from one
topology; `noded` sees to it where they don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.graph import components
from hustings.workers import temporary, written

MOST_ROUNDS = 64
#: Pairs that one task compares, about.
PAIRS = 8_000_000


def edges(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, ax, ay, bx, by): all directed edges, those of no length left out; null and empty rings have none."""
    at = lambda i, c: F.get(ring, i)[c].cast("double")
    e = polygons.filter(F.size(ring) > 0).select(key, ring, F.explode(F.sequence(F.lit(0), F.size(ring) - 1)).alias("__i"))
    after = F.pmod(F.col("__i") + 1, F.size(ring))
    e = e.select(key, at(F.col("__i"), "x").alias("ax"), at(F.col("__i"), "y").alias("ay"), at(after, "x").alias("bx"), at(after, "y").alias("by"))
    return e.filter("ax <> bx OR ay <> by")


def _ends() -> list[Column]:
    """The two ends in one order, so that both directions of a segment are equal."""
    turned = F.struct("bx", "by") < F.struct("ax", "ay")
    return [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(n) for a, b, n in (("ax", "bx", "lx"), ("ay", "by", "ly"), ("bx", "ax", "hx"), ("by", "ay", "hy"))]


SEGMENT = ["lx", "ly", "hx", "hy"]
LENGTH = "sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly))"


def noded(e: DataFrame, cell: float) -> DataFrame:
    """Edges cut at all vertices (of any key) that lie on them, exactly, so that neighbours share vertices. Vertices and edges meet by grid cell."""
    e = written(e.withColumn("__e", F.monotonically_increasing_id()), "edges")
    down = lambda c: F.floor(c / cell)
    spread = e.withColumn("__cx", F.explode(F.sequence(down(F.least("ax", "bx")), down(F.greatest("ax", "bx"))))).withColumn("__cy", F.explode(F.sequence(down(F.least("ay", "by")), down(F.greatest("ay", "by")))))
    dots = e.select(F.col("ax").alias("x"), F.col("ay").alias("y")).distinct().withColumns({"__cx": down(F.col("x")), "__cy": down(F.col("y"))})
    along = F.expr("(bx - ax) * (x - ax) + (by - ay) * (y - ay)")
    on = spread.join(dots, ["__cx", "__cy"]).filter(F.expr("(bx - ax) * (y - ay) = (by - ay) * (x - ax)")).withColumn("t", along).filter("t > 0 AND t < (bx - ax) * (bx - ax) + (by - ay) * (by - ay)")
    cuts = on.groupBy("__e").agg(F.array_sort(F.collect_set(F.struct("t", "x", "y"))).alias("__cuts"))
    dot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    inner = F.coalesce(F.transform("__cuts", lambda c: dot(c["x"], c["y"])), F.array().cast("array<struct<x:double,y:double>>"))
    path = F.concat(F.array(dot(F.col("ax"), F.col("ay"))), inner, F.array(dot(F.col("bx"), F.col("by"))))
    names = [c for c in e.columns if c not in ("ax", "ay", "bx", "by", "__e")]
    out = e.join(cuts, "__e", "left").select(*names, path.alias("__p")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.size("__p") - 2)))
    p, q = F.get("__p", F.col("__i")), F.get("__p", F.col("__i") + 1)
    return out.select(*names, p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))


def shared_borders(e: DataFrame, key: str) -> DataFrame:
    """(a, b, length) of keys a < b with a common border: the segments that both have."""
    s = e.select(key, *_ends()).distinct()
    both = s.withColumnRenamed(key, "a").join(s.withColumnRenamed(key, "b"), SEGMENT).filter("a < b")
    return both.groupBy("a", "b").agg(F.sum(F.expr(LENGTH)).alias("length"))


def coast_ratio(e: DataFrame, key: str, least: float = 0.2) -> DataFrame:
    """(key, border, coast, ratio, is_coastal): how much of a key's border no other key has. Segments within a key, between its own parts, aren't border."""
    once = e.select(key, *_ends()).groupBy(key, *SEGMENT).agg(F.count("*").alias("n")).filter("n = 1")
    keys = once.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.min(key).alias(key))
    border = once.join(keys.filter("n = 1").select(*SEGMENT, F.lit(True).alias("__alone")), SEGMENT, "left")
    s = border.groupBy(key).agg(F.sum(F.expr(LENGTH)).alias("border"), F.sum(F.when(F.col("__alone"), F.expr(LENGTH)).otherwise(0.0)).alias("coast"))
    return s.withColumn("ratio", F.col("coast") / F.col("border")).withColumn("is_coastal", F.col("ratio") > least)


def dissolved(e: DataFrame, key: str) -> DataFrame:
    """(key, ring, area): the outlines of each key's union, from the edges of its parts; outer rings have a positive area, holes a negative one.

    An edge that a part of the key has the other way round is inner and goes. Rings of what is left are found by doubling: each edge knows one that
    lies 1, 2, 4, ... steps ahead, and the least edge seen; then all know their ring and their place in it, after about log2 of the longest ring rounds.
    Where more than two edges meet in a vertex, the path takes the sharpest turn to the left, so parts that touch in a vertex alone are rings of their own.
    """
    with temporary(e.sparkSession) as keep:
        one, two = F.struct("ax", "ay"), F.struct("bx", "by")
        sums = e.withColumn("__way", F.when(one < two, 1).otherwise(-1)).select(key, "__way", *_ends()).groupBy(key, *SEGMENT).agg(F.sum("__way").alias("way")).filter("way <> 0")
        turned = [F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("lx", "hx", "ax"), ("ly", "hy", "ay"), ("hx", "lx", "bx"), ("hy", "ly", "by"))]
        outer = written(sums.select(key, *turned).withColumn("e", F.monotonically_increasing_id()), "outer")
        ahead = outer.select(key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("e").alias("next"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("out"))
        back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
        turn = F.pmod(F.col("out") - back - 1e-9, F.lit(2 * 3.141592653589793))  # counter-clockwise from where we came: the greatest is the sharpest left
        jump = outer.join(ahead, [key, "bx", "by"]).groupBy("e").agg(F.max_by("next", F.struct(turn, "next")).alias("next"))
        # the least edge of each ring
        seen = written(jump.withColumn("least", F.least("e", "next")), "jumps")
        for _ in range(MOST_ROUNDS):
            far = seen.select(F.col("e").alias("next"), F.col("next").alias("then"), F.col("least").alias("other"))
            new = written(seen.join(far, "next").select("e", F.col("then").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), "jumps")
            seen = new.select("e", "next", "least")
            if not new.filter("moved").take(1):
                break
        # steps to the least edge, which stays where it is
        leader = seen.select("e", "least")
        rank = written(jump.join(leader, "e").select("e", "least", F.when(F.col("next") == F.col("least"), F.lit(None)).otherwise(F.col("next")).alias("next"), F.lit(0).cast("long").alias("left")), "ranks")
        rank = rank.withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"))
        for _ in range(MOST_ROUNDS):
            if not rank.filter("next IS NOT NULL").take(1):
                break
            far = rank.select(F.col("e").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
            rank = written(rank.join(far, "next", "left").select("e", "least", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "ranks")
        rows = outer.join(rank.select("e", "least", "left"), "e")
        ring = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), F.col("ax").alias("x"), F.col("ay").alias("y"))))  # a ring is one row of the result
        rings = rows.groupBy(key, "least").agg(ring.alias("ring"), (F.sum(F.expr("ax * by - bx * ay")) / 2).alias("area"))
        return keep(written(rings.select(key, F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), "area"), "dissolved"))


def simplified(points: DataFrame, line: list[str], pos: str, x: str, y: str, tolerance: float) -> DataFrame:
    """The points of lines that Douglas-Peucker keeps: (line, pos, x, y). pos orders a line's points and is distinct within it.

    All open stretches of all lines are split at once, each at its farthest point (the first of those as far), until none has a point
    further than the tolerance from its chord; so rounds are as many as the deepest stretch, and a round is two aggregations, whatever the lines'
    lengths. A line of one or two points stays. Points without a place are left out.
    """
    with temporary(points.sparkSession) as keep:
        p = points.select(*line, pos, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
        p = written(p, "points")
        key = [F.col(c).alias(f"__{i}") for i, c in enumerate(line)]
        same = lambda: [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(line)]
        end = lambda f: f(F.struct(F.col(pos).alias("at"), "x", "y"))
        spans = p.groupBy(*line).agg(end(F.min).alias("lo"), end(F.max).alias("hi"))
        kept = [spans.select(*line, "lo.*"), spans.filter("hi.at <> lo.at").select(*line, "hi.*")]
        joined = lambda a, b: a.join(b.select(*key, *[c for c in b.columns if c not in line]), same(), "inner").drop(*[f"__{i}" for i in range(len(line))])
        open_ = written(joined(p, spans).filter((F.col(pos) > F.col("lo.at")) & (F.col(pos) < F.col("hi.at"))), "open")
        for _ in range(MOST_ROUNDS * 16):
            if not open_.take(1):
                return keep(written(_union(kept).withColumnRenamed("at", pos).select(*line, pos, "x", "y"), "simplified"))
            dx, dy = F.col("hi.x") - F.col("lo.x"), F.col("hi.y") - F.col("lo.y")
            chord = F.sqrt(dx * dx + dy * dy)
            off = F.abs(dx * (F.col("y") - F.col("lo.y")) - dy * (F.col("x") - F.col("lo.x")))
            beside = F.sqrt((F.col("x") - F.col("lo.x")) ** 2 + (F.col("y") - F.col("lo.y")) ** 2)
            far = F.when(chord > 0, off / chord).otherwise(beside)
            best = open_.withColumn("__far", far).groupBy(*line, F.col("lo.at").alias("__lo")).agg(F.max("__far").alias("__most"), F.max_by(F.struct(F.col(pos).alias("at"), "x", "y"), F.struct("__far", -F.col(pos))).alias("cut"))
            best = written(best.filter(F.col("__most") > tolerance).drop("__most"), "cuts")
            kept.append(best.select(*line, "cut.*"))
            b = best.select(*key, "__lo", "cut")
            cond = [*same(), F.col("lo.at") == F.col("__lo")]
            left = open_.join(b, cond).filter(F.col(pos) != F.col("cut.at")).drop("__lo", *[f"__{i}" for i in range(len(line))])
            before = F.col(pos) < F.col("cut.at")
            open_ = written(left.withColumns({"lo": F.when(before, F.col("lo")).otherwise(F.col("cut")), "hi": F.when(before, F.col("cut")).otherwise(F.col("hi"))}).drop("cut"), "open")
        raise RuntimeError("lines did not settle")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in_blocks(left: DataFrame, right: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Both with their cells' blocks, partitioned to be joined by cx, cy and block, and how many partitions there are: a cell whose pairs are too many for a
    task is cut into blocks of right rows by the column name, and left rows go to each of them."""
    count = lambda df, c: df.groupBy("cx", "cy").agg(F.count("*").alias(c))
    cells = count(left, "n").join(count(right, "m"), ["cx", "cy"]).withColumn("__pairs", F.col("n").cast("double") * F.col("m"))
    cells = written(cells.select("cx", "cy", F.ceil(F.col("__pairs") / PAIRS).alias("__blocks"), "__pairs"), "cells")
    parts = int((cells.agg(F.sum("__pairs")).first()[0] or 0) // PAIRS) + int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.drop("__pairs")
    by = [F.col(c) for c in ("cx", "cy", "block")]
    every = left.join(cells, ["cx", "cy"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).drop("__blocks")
    own = right.join(cells, ["cx", "cy"]).withColumn("block", F.pmod(F.xxhash64(name), "__blocks")).drop("__blocks")
    return every.repartition(parts, *by), own.repartition(parts, *by), parts


def contacts(polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """(a, b) of keys a < b whose polygons touch, cross or hold one another.

    Edges meet in the grid cells of their boxes; a pair of edges counts in one cell only, that of the lower left corner of what their boxes share. A
    polygon within another shares no edge with it: a vertex of each ring is looked up in the polygons whose boxes it is in, too. Even-odd, so a hole's inside is
    outside. Pairs in crowded cells are as many as they are; they are compared in blocks of bounded size, and the more there are the more tasks there are.
    """
    with temporary(polygons.sparkSession) as keep:
        e = written(edges(polygons, key, ring), "edges")
        down = lambda c: F.floor(c / cell)
        box = e.withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")})
        spread = box.withColumn("cx", F.explode(F.sequence(down(F.col("x0")), down(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(down(F.col("y0")), down(F.col("y1")))))
        spread = written(spread, "spread")
        other = spread.select("cx", "cy", *[F.col(c).alias(f"{c}2") for c in (key, "ax", "ay", "bx", "by", "x0", "x1", "y0", "y1")])
        every, own, parts = _in_blocks(spread, other, f"{key}2")
        near = every.join(own, ["cx", "cy", "block"]).filter((F.col(key) < F.col(f"{key}2")) & F.expr("greatest(x0, x02) <= least(x1, x12) AND greatest(y0, y02) <= least(y1, y12)"))
        near = near.filter((down(F.greatest("x0", "x02")) == F.col("cx")) & (down(F.greatest("y0", "y02")) == F.col("cy")))
        side = lambda ax, ay, bx, by, x, y: f"sign(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}))"
        first = [side("ax", "ay", "bx", "by", *p) for p in (("ax2", "ay2"), ("bx2", "by2"))]
        second = [side("ax2", "ay2", "bx2", "by2", *p) for p in (("ax", "ay"), ("bx", "by"))]
        meet = F.expr(f"{first[0]} * {first[1]} <= 0 AND {second[0]} * {second[1]} <= 0")  # boxes meet, so edges in one line meet, too
        crossing = near.filter(meet).groupBy("cx", "cy", "block", F.col(key).alias("a"), F.col(f"{key}2").alias("b")).agg(F.count("*")).select("a", "b")

        # a vertex of each ring against the edges right of it, of polygons whose boxes it is in
        dots = polygons.filter(F.size(ring) > 0).select(F.col(key).alias("inner"), F.get(ring, F.lit(0))["x"].cast("double").alias("x"), F.get(ring, F.lit(0))["y"].cast("double").alias("y"))
        dots = written(dots.withColumns({"dot": F.monotonically_increasing_id(), "cx": down(F.col("x")), "cy": down(F.col("y"))}), "dots")
        whole = box.groupBy(F.col(key).alias("outer")).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))])
        boxes = whole.withColumn("cx", F.explode(F.sequence(down(F.col("x0")), down(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(down(F.col("y0")), down(F.col("y1")))))
        every_dot, own_boxes, dot_parts = _in_blocks(dots, written(boxes, "boxes"), "outer")
        within = every_dot.join(own_boxes, ["cx", "cy", "block"]).filter(F.expr("inner <> outer AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")).select("dot", "inner", "outer", "x", "y", "cy")
        rows = box.withColumn("cy", F.explode(F.sequence(down(F.col("y0")), down(F.col("y1"))))).select("cy", F.col(key).alias("outer"), "ax", "ay", "bx", "by")
        places = [F.col("outer"), F.col("cy")]
        met = within.repartition(dot_parts, *places).join(rows.repartition(dot_parts, *places), ["outer", "cy"])
        right = met.filter(F.expr("(ay > y) <> (by > y) AND x < (bx - ax) * (y - ay) / (by - ay) + ax"))
        inside = right.groupBy("outer", "cy", "dot", "inner").agg(F.count("*").alias("n")).filter("n % 2 = 1")
        held = inside.select(F.least("inner", "outer").alias("a"), F.greatest("inner", "outer").alias("b"))
        return keep(written(crossing.unionByName(held).repartition(parts, "a", "b").distinct(), "contacts"))


def absorbed(parts: DataFrame, borders: DataFrame, part: str, owner: str, loose: str) -> DataFrame:
    """(part, owner) of all parts: loose ones join the neighbour with which they share the longest border, the least of those as long, and so on until
    none is left that can reach an owned one. borders: (a, b, length) of neighbouring parts, each pair once. Loose parts that reach none have a null owner.

    Each round, every group of parts without an owner picks one neighbouring group; groups that picked each other grow together, so the
    number of groups without an owner at least halves. Nothing depends on the order of rows.
    """
    with temporary(parts.sparkSession) as keep:
        own = parts.select(F.col(part).cast("long").alias("p"), F.when(~F.col(loose), F.col(owner)).alias("o"), F.col(loose).alias("l"))
        # parts that aren't loose are one group each and never pick
        groups = written(own.withColumn("g", F.col("p")), "groups")
        both = borders.select("a", "b", "length").union(borders.select("b", "a", "length"))
        both = written(both.select(F.col("a").cast("long").alias("p"), F.col("b").cast("long").alias("q"), "length"), "borders")
        for _ in range(MOST_ROUNDS):
            of = groups.select("p", "g", "l")
            b = both.join(of, "p").join(of.select(F.col("p").alias("q"), F.col("g").alias("h"), F.col("l").alias("m")), "q").filter("l AND g <> h")
            wish = b.groupBy("g", "h").agg(F.sum("length").alias("length")).groupBy("g").agg(F.max_by("h", F.struct("length", -F.col("h"))).alias("h"))
            wish = written(wish, "wishes")
            if not wish.take(1):
                break
            # groups joined by wishes are one; it has at most one part that isn't loose, whose owner it takes
            label = components(wish.select(F.col("g").alias("a"), F.col("h").alias("b")))
            new = groups.join(label.withColumnRenamed("node", "g"), "g", "left").withColumn("g", F.coalesce("component", "g")).drop("component")
            held = new.groupBy("g").agg(F.min(F.when(~F.col("l"), F.struct("p", "o"))).alias("held"))
            new = new.join(held, "g").withColumns({"o": F.coalesce("o", F.col("held.o")), "l": F.col("l") & F.col("held").isNull()})
            groups = written(new.select("p", "o", "l", "g"), "groups")
        else:
            raise RuntimeError("parts did not settle")
        return keep(written(groups.select(F.col("p").alias(part), F.col("o").alias(owner)), "absorbed"))


def enclosed(parts: DataFrame, borders: DataFrame, coast: DataFrame, part: str, covered: str) -> DataFrame:
    """parts that aren't covered, with is_enclosed: no way through parts that aren't covered leads to the outer border (coast: the parts on it)."""
    bare = parts.filter(~F.col(covered)).select(F.col(part).cast("long").alias("p"))
    inner = borders.join(bare.withColumnRenamed("p", "a"), "a", "left_semi").join(bare.withColumnRenamed("p", "b"), "b", "left_semi")
    labels = bare.join(components(inner.select("a", "b")).withColumnRenamed("node", "p"), "p", "left").withColumn("g", F.coalesce("component", "p"))
    outside = labels.join(coast.select(F.col(part).cast("long").alias("p")).distinct(), "p", "left_semi").select("g").distinct().withColumn("__out", F.lit(True))
    return labels.join(outside, "g", "left").select(F.col("p").alias(part), F.col("__out").isNull().alias("is_enclosed"))


def nearest_seeds(cells: DataFrame, seeds: DataFrame, x: str, y: str, seed: str) -> DataFrame:
    """cells (integer x, y) with the nearest seed, by squared distance and then id: a Voronoi split of a grid.

    Flooding first: over the box of all cells, every place tells the seeds it knows to places 2^k, ..., 2, 1 away, which gives each a seed that is the nearest
    or nearly so. Then what is exact: no nearer seed lies beyond that distance, so each cell meets the seeds of the tiles its circle touches. Tiles
    are as wide as the mean distance between seeds. Cells without a place get no seed; without seeds nobody does.
    """
    with temporary(cells.sparkSession) as keep:
        s = written(seeds.select(F.col(x).cast("long").alias("sx"), F.col(y).cast("long").alias("sy"), F.col(seed).alias("s")).filter("sx IS NOT NULL AND sy IS NOT NULL AND s IS NOT NULL").groupBy("sx", "sy").agg(F.min("s").alias("s")), "seeds")
        place = cells.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").distinct()
        every = place.union(s.select("sx", "sy"))
        box = every.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
        n = s.count()
        if not n:
            return cells.withColumn(seed, F.lit(None).cast(seeds.schema[seed].dataType))
        # cells of the box at a coarse scale, so that flooding costs no more places than there are cells
        width, height = box["x1"] - box["x0"] + 1, box["y1"] - box["y0"] + 1
        tile = max(1, int((width * height / n) ** 0.5))
        across, down = (width - 1) // tile + 1, (height - 1) // tile + 1
        to = lambda cx, cy: [F.floor((F.col(cx) - box["x0"]) / tile).alias("tx"), F.floor((F.col(cy) - box["y0"]) / tile).alias("ty")]
        far = lambda: F.expr("(sx - mx) * (sx - mx) + (sy - my) * (sy - my)")
        middle = lambda df: df.withColumns({"mx": F.col("tx") * tile + box["x0"] + tile / 2, "my": F.col("ty") * tile + box["y0"] + tile / 2})
        nearest = lambda df: middle(df).groupBy("tx", "ty").agg(F.min(F.struct(far().alias("d"), "s", "sx", "sy")).alias("m")).select("tx", "ty", "m.s", "m.sx", "m.sy")
        known = written(nearest(s.select(*to("sx", "sy"), "s", "sx", "sy")), "flood")
        step = 1 << max(across, down).bit_length()
        while step:
            sent = known.withColumn("dx", F.explode(F.array(*map(F.lit, (-step, 0, step))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-step, 0, step)))))
            sent = sent.select((F.col("tx") + F.col("dx")).alias("tx"), (F.col("ty") + F.col("dy")).alias("ty"), "s", "sx", "sy").filter((F.col("tx") >= 0) & (F.col("tx") < across) & (F.col("ty") >= 0) & (F.col("ty") < down))
            known = written(nearest(sent), "flood")
            step //= 2
        # the seed of a cell's tile bounds its distance; all seeds within it lie in the tiles of the circle's box
        own = place.select("x", "y", *to("x", "y")).join(known, ["tx", "ty"])
        reach = F.sqrt(F.expr("(sx - x) * (sx - x) + (sy - y) * (sy - y)").cast("double"))
        low = lambda c, c0: F.greatest(F.lit(0), F.floor((F.col(c) - F.col("reach") - c0) / tile))
        high = lambda c, c0, most: F.least(F.lit(most - 1), F.floor((F.col(c) + F.col("reach") - c0) / tile))
        asks = own.withColumn("reach", reach).withColumn("qx", F.explode(F.sequence(low("x", box["x0"]), high("x", box["x0"], across)))).withColumn("qy", F.explode(F.sequence(low("y", box["y0"]), high("y", box["y0"], down))))
        dealt = s.select(*[c.alias(q) for c, q in zip(to("sx", "sy"), ("qx", "qy"), strict=True)], F.col("sx").alias("ox"), F.col("sy").alias("oy"), F.col("s").alias("o"))
        best = asks.select("x", "y", "qx", "qy").join(dealt, ["qx", "qy"]).groupBy("x", "y").agg(F.min(F.struct(F.expr("(ox - x) * (ox - x) + (oy - y) * (oy - y)").alias("d"), "o")).alias("m"))
        named = best.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("m.o").alias(seed))
        return keep(written(cells.join(named, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left").drop("__x", "__y"), "voronoi"))

"""Queries over polygons, grids and turns; shapes are built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import assignment, matching, polygons, turns
from hustings.plans.layout_queries import CELLS_SQL, _cells
from hustings.plans.tables import POLLS_SQL, polls, table


def _squares(spark, sf_dir, key="zone"):
    """The cells as unit squares, counter-clockwise."""
    at = lambda dx, dy: F.struct((F.col("c") + dx).cast("double").alias("x"), (F.col("r") + dy).cast("double").alias("y"))
    return _cells(spark, sf_dir).select(F.col(key).alias("zone"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


def coast_ratio(spark, sf_dir):
    out = polygons.coast_ratio(polygons.edges(_squares(spark, sf_dir), "zone", "ring"), "zone")
    return out.select("zone", F.round("border", 6).alias("border"), F.round("coast", 6).alias("coast"), "is_coastal")


def shared_borders(spark, sf_dir):
    out = polygons.shared_borders(polygons.edges(_squares(spark, sf_dir, "key"), "zone", "ring"), "zone")
    return out.select("a", "b", F.round("length", 6).alias("length"))


def dissolved_outlines(spark, sf_dir):
    out = polygons.dissolved(polygons.edges(_squares(spark, sf_dir), "zone", "ring"), "zone")
    sides = F.size("ring").cast("long")
    return out.groupBy("zone").agg(F.count("*").alias("rings"), F.count_if(F.col("area") < 0).alias("holes"), F.round(F.sum("area"), 6).alias("area"), F.sum(sides).alias("sides"))


def simplified_lines(spark, sf_dir):
    days = polls(spark, sf_dir).groupBy("user_id", F.unix_date("day").alias("d")).agg(F.max("pct").alias("most"))
    return polygons.simplified(days.withColumn("x", F.col("d").cast("double")), ["user_id"], "d", "x", "most", 8.0).select("user_id", "d", "y")


def _boxes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 37 % 211).alias("x"), (F.col("s_suppkey") * 101 % 197).alias("y"), (1 + F.col("s_nationkey") % 23).alias("w"), (1 + F.col("s_suppkey") % 19).alias("h"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    zero = F.lit(0)
    return s.select("k", F.array(at(zero, zero), at(F.col("w"), zero), at(F.col("w"), F.col("h")), at(zero, F.col("h"))).alias("ring"))


def polygon_contacts(spark, sf_dir):
    return polygons.contacts(_boxes(spark, sf_dir), "k", "ring", 16.0)


def voronoi_cells(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 11 % 60).alias("c"), (F.col("s_suppkey") * 17 % 40).alias("r"), F.col("s_suppkey").alias("seed"))
    return polygons.nearest_seeds(_cells(spark, sf_dir).select("key", "c", "r"), seeds, "c", "r", "seed").select("key", "seed")


def absorbed_parts(spark, sf_dir):
    """Cells of zone 0 belong to nobody: those that are enclosed go to the neighbours they share most border with."""
    squares = _squares(spark, sf_dir, "key").withColumnRenamed("zone", "key")
    e = polygons.edges(squares, "key", "ring")
    borders = polygons.shared_borders(e, "key")
    parts = _cells(spark, sf_dir).select("key", "zone", (F.col("zone") != 0).alias("covered"))
    coast = polygons.coast_ratio(e, "key").filter("coast > 0").select("key")
    inner = polygons.enclosed(parts, borders, coast, "key", "covered")
    marked = parts.join(inner, "key", "left").withColumn("loose", F.coalesce("is_enclosed", F.lit(False)))
    owned = marked.withColumn("owner", F.when(F.col("covered"), F.col("zone")))
    out = polygons.absorbed(owned, borders, "key", "owner", "loose")
    return out.join(marked.select("key", "loose"), "key").select("key", "owner", "loose")


def hex_bins(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7919 % 1000 / 10).alias("x"), F.col("s_acctbal").alias("y"))
    return turns.placed(turns.grid_start(s, "x", "y"), [F.desc("y"), F.col("x"), F.col("s_suppkey")]).select("s_suppkey", "c", "r")


def optimal_assignment(spark, sf_dir):
    """Suppliers of each nation are given the nation's places, one each, at the least sum of distances."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 37 % 101).alias("x"), (F.col("s_suppkey") * 59 % 97).alias("spot"))
    places = s.select("s_nationkey", F.col("s_suppkey").alias("place"), "spot")
    chosen, report = assignment.assigned_by_kind(s.drop("spot"), places, ["s_nationkey"], "s_suppkey", "place", F.abs(F.col("x") - F.col("spot")))
    n = chosen.groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("agents"), F.count_distinct("place").alias("places"))
    return report.join(n, "s_nationkey").select("s_nationkey", "agents", "places", "total", (F.col("gap") < 1).alias("proven"))


def paired_cells(spark, sf_dir):
    return matching.paired(_cells(spark, sf_dir), "zone").groupBy("zone", "component").agg(F.count("*").alias("cells"), (F.count("c2") / 2).cast("long").alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (coast_ratio, shared_borders, dissolved_outlines, simplified_lines, polygon_contacts, voronoi_cells, absorbed_parts, hex_bins, optimal_assignment, paired_cells)
}

#: Sides of cells: the cell beside each, and the side's place.
SIDES_SQL = f"""{CELLS_SQL}, sides as (select cells.*, c + dc as nc, r + dr as nr from cells, (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(dc, dr)),
met as (select s.*, o.zone as other, o.key as other_key, o.c is not null as there from sides s left join cells o on o.c = s.nc and o.r = s.nr)"""

ORACLE_SQL = {
    # the least costs over sets of places that are taken, agent by agent
    "optimal_assignment": """with recursive s as materialized (select s_nationkey as g, s_suppkey * 37 % 101 as x, s_suppkey * 59 % 97 as spot, row_number() over (partition by s_nationkey order by s_suppkey) as i from supplier),
n as (select g, count(*) as n from s group by 1),
d(g, i, mask, cost) as (select g, 0, cast(0 as bigint), cast(0 as bigint) from n
  union all select g, i, mask, min(cost) from (select d.g, d.i + 1 as i, d.mask | (cast(1 as bigint) << (p.i - 1)) as mask, d.cost + abs(a.x - p.spot) as cost
    from d join s a on a.g = d.g and a.i = d.i + 1 join s p on p.g = d.g and d.mask & (cast(1 as bigint) << (p.i - 1)) = 0) group by 1, 2, 3)
select d.g as s_nationkey, n as agents, n as places, cost as total, true as proven from d join n on n.g = d.g and d.i = n.n""",
    "coast_ratio": f"""with {SIDES_SQL} select zone, cast(count(*) as double) as border, cast(count(*) filter (not there) as double) as coast, count(*) filter (not there) > 0.2 * count(*) as is_coastal
from met where not there or other <> zone group by 1""",
    "shared_borders": f"with {SIDES_SQL} select key as a, other_key as b, cast(count(*) as double) as length from met where there and key < other_key group by 1, 2",
    "dissolved_outlines": f"""with recursive {SIDES_SQL}, reach(key, other) as (select key, key from cells union select reach.key, met.other_key from reach join met on met.key = reach.other where there and zone = met.other),
comps as (select zone, count(distinct least) as n from (select key, min(other) as least from reach group by 1) join cells using (key) group by 1),
faces as (select zone, count(*) as f from cells group by 1), inner_edges as (select zone, count(*) // 2 as e from met where there and zone = other group by 1),
corners as (select zone, count(*) as v from (select zone, c + dc as x, r + dr as y from cells, (values (0, 0), (0, 1), (1, 0), (1, 1)) s(dc, dr) group by all having count(*) = 4) group by 1),
border as (select zone, count(*) as s from met where not there or zone <> other group by 1)
select zone, 2 * n - (f - coalesce(e, 0) + coalesce(v, 0)) as rings, n - (f - coalesce(e, 0) + coalesce(v, 0)) as holes, cast(f as double) as area, s as sides
from comps join faces using (zone) join border using (zone) left join inner_edges using (zone) left join corners using (zone)""",
    "simplified_lines": f"""with recursive {POLLS_SQL}, p as materialized (select user_id, cast(day - date '1970-01-01' as int) as d, max(pct) as y from polls group by 1, 2),
s(user_id, lo, hi) as (select user_id, min(d), max(d) from p group by 1
  union all select user_id, unnest([lo, spot]) as lo, unnest([spot, hi]) as hi from (
    select s.user_id, lo, hi, arg_max(p.d, (abs((hi - lo) * (p.y - a.y) - (b.y - a.y) * (p.d - lo)) / sqrt((hi - lo) * (hi - lo) + (b.y - a.y) * (b.y - a.y)), -p.d)) as spot,
      max(abs((hi - lo) * (p.y - a.y) - (b.y - a.y) * (p.d - lo)) / sqrt((hi - lo) * (hi - lo) + (b.y - a.y) * (b.y - a.y))) as far
    from s join p a on a.user_id = s.user_id and a.d = lo join p b on b.user_id = s.user_id and b.d = hi join p on p.user_id = s.user_id and p.d > lo and p.d < hi group by all) where far > 8)
select user_id, d, y from p where exists (select 1 from s where s.user_id = p.user_id and (s.lo = p.d or s.hi = p.d))""",
    "polygon_contacts": """with b as (select s_suppkey as k, s_suppkey * 37 % 211 as x, s_suppkey * 101 % 197 as y, 1 + s_nationkey % 23 as w, 1 + s_suppkey % 19 as h from supplier)
select p.k as a, q.k as b from b p join b q on p.k < q.k and p.x <= q.x + q.w and q.x <= p.x + p.w and p.y <= q.y + q.h and q.y <= p.y + p.h""",
    "voronoi_cells": f"""with {CELLS_SQL}, s as (select s_suppkey * 11 % 60 as x, s_suppkey * 17 % 40 as y, s_suppkey as seed from supplier)
select key, arg_min(seed, ((c - x) * (c - x) + (r - y) * (r - y), seed)) as seed from cells, s group by 1""",
    "hex_bins": """with recursive p as (select s_suppkey as k, s_suppkey * 7919 % 1000 / 10 as x, s_acctbal as y from supplier),
e as (select count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, greatest(1, cast(round_even(sqrt(1.3 * count(*) / 2.3), 0) as int)) as w from p),
g as (select k, x, y, w, greatest(1, cast(round_even(2.3 * w, 0) as int)) as h, x0, x1, y0, y1 from p, e),
v as (select *, cast(round_even((y1 - y) / (y1 - y0 + 1e-9) * (h - 1), 0) as bigint) as r0 from g),
u as materialized (select k, r0, cast(round_even((x - x0) / (x1 - x0 + 1e-9) * (w - 1) - case when r0 % 2 = 1 then 0.5 else 0 end, 0) as bigint) as c0, row_number() over (order by y desc, x, k) as i from v),
cells as materialized (select c, r, c - (r - (r % 2 + 2) % 2) // 2 as q from range(-30, 60) a(c), range(-30, 90) b(r)),
near as materialized (select i, c, r, row_number() over (partition by i order by (abs(q - q0) + abs(r - r0) + abs(q + r - q0 - r0)), r, c) as place
  from (select *, c0 - (r0 - (r0 % 2 + 2) % 2) // 2 as q0 from u) u, cells where abs(q - q0) + abs(r - r0) + abs(q + r - q0 - r0) <= 24),
t(i, taken) as (select 0, cast([] as bigint[]) union all select t.i + 1, list_append(any_value(taken), arg_min((c + 1000) * 10000 + r + 1000, place))
  from t join near on near.i = t.i + 1 where not list_contains(taken, (c + 1000) * 10000 + r + 1000) group by t.i)
select k as s_suppkey, cast(taken[u.i] // 10000 - 1000 as bigint) as c, cast(taken[u.i] % 10000 - 1000 as bigint) as r from u, (select taken from t order by i desc limit 1)""",
}

"""Queries of adapters and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import adapters, geometry
from hustings.plans.tables import PLACED_SQL, POLLS_SQL, POS, options, placed, polls, table


def nested_races(spark, sf_dir):
    o = options(spark, sf_dir).withColumn("minus", -F.col("l_quantity"))
    races = adapters.nested(o, ["l_orderkey"], ["l_suppkey", "l_quantity"], ["minus", *POS])
    return races.select("l_orderkey", F.size("candidates").cast("long").alias("n"), F.get("candidates", F.lit(0))["l_suppkey"].alias("first"))


def legacy_rows(spark, sf_dir):
    o = placed(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("voted"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("voters"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).otherwise(0)).alias("electors"), F.min("n_name").alias("unit"))
    o = o.withColumn("sigungu", F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.col("unit"))).withColumn("sido", F.when(F.col("l_orderkey") % 2 == 0, F.lit("s"))).withColumn("candidates", F.lit(None).cast("string"))
    return adapters.legacy(o, ["sigungu", "sido"]).groupBy("place").agg(F.count("*").alias("n"), F.sum("voters").alias("voters"), F.round(F.sum("turnout"), 4).alias("turnouts"))


def area_modes(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("level", F.when(F.col("r_name") < "AN", "broadcast").when(F.col("r_name") < "B", "area").otherwise("part"))
    out = adapters.area_rows(p.withColumn("s", F.col("l_quantity")), ["r_name"], "level", ["l_returnflag"], "l_quantity", "s", ["l_orderkey", *POS])
    return out.withColumn("share", F.round("share", 6))


def stack_composition(spark, sf_dir):
    out = adapters.composition(placed(spark, sf_dir), "l_linenumber", "n_name", "l_quantity", [], 4)
    return out.withColumn("share", F.round("share", 6)).withColumn("place", F.col("place").cast("long"))


def margin_opacity(spark, sf_dir):
    return polls(spark, sf_dir).select("event_id", F.round(adapters.opacity(F.col("pct") - 50), 6).alias("opacity"))


def source_kinds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", adapters.source_kind(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F").alias("source"))


def neighbours_in_time(spark, sf_dir):
    out = adapters.neighbours_in_time(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey"])
    return out.select("o_orderkey", "previous", "next")


def highest_title(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("won", F.col("o_orderstatus") == "F")
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    return adapters.title_of(o, ["o_custkey"], "o_orderpriority", order, "won")


def tie_broken(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 200).alias("name"), F.col("c_mktsegment").alias("kind"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("place"))
    f = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 70).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("kind"), F.col("s_nationkey").cast("string").alias("place"), F.col("s_suppkey").alias("born"))
    return adapters.tie_broken(c, f, ["name"], "k", "kind", "place", "born").select("k", "born")


def _rings(spark, sf_dir):
    """Rhombs around places of nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), (F.col("n_nationkey") * 37 % 100).cast("double").alias("cx"), (F.col("n_nationkey") * 53 % 100).cast("double").alias("cy"))
    corner = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    return n.select("zone", F.array(corner(12, 0), corner(0, 12), corner(-12, 0), corner(0, -12)).alias("ring"))


def ring_measures(spark, sf_dir):
    r = _rings(spark, sf_dir)
    c = geometry.vertex_mean(geometry.largest(F.array(F.transform("ring", lambda p: F.struct((p["x"] / 2).alias("x"), (p["y"] / 2).alias("y"))), F.col("ring"))))
    return r.select("zone", geometry.signed_area(F.col("ring")).alias("area"), c["x"].alias("x"), c["y"].alias("y"))


def points_in_zones(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 17 % 101 + 0.25).cast("double").alias("x"), (F.col("p_partkey") * 29 % 103 + 0.35).cast("double").alias("y"))
    return geometry.located(p, _rings(spark, sf_dir), "x", "y", "zone", "ring", 10.0).select("p_partkey", "zone")


QUERIES = {
    f.__name__: f
    for f in (nested_races, legacy_rows, area_modes, stack_composition, margin_opacity, source_kinds, neighbours_in_time, highest_title, tie_broken, ring_measures, points_in_zones)
}

ORACLE_SQL = {
    "nested_races": "select l_orderkey, count(*) as n, arg_min(l_suppkey, (-l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as first from lineitem group by 1",
    "legacy_rows": f"""with {PLACED_SQL}, o as (select l_orderkey, sum(l_linenumber) as voted, sum(l_linenumber) filter (l_returnflag = 'A') as voters, sum(case when l_linestatus = 'O' then l_partkey else 0 end) as electors, min(n_name) as unit from placed group by 1),
l as (select coalesce(case when l_orderkey % 3 <> 0 then unit end, case when l_orderkey % 2 = 0 then 's' end, 'nation') as place, coalesce(voters, voted) as voters, electors from o)
select place, count(*) as n, cast(sum(voters) as bigint) as voters, round(sum(round(case when electors > 0 then voters / electors * 100 else 0 end, 2)), 4) as turnouts from l group by 1""",
    "area_modes": f"""with {PLACED_SQL}, f as (select r_name, l_returnflag, l_quantity as share from placed where r_name < 'B'
  qualify row_number() over (partition by r_name, l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1),
s as (select r_name, l_returnflag, sum(l_quantity) as v from placed where r_name >= 'B' group by 1, 2)
select r_name, l_returnflag, round(share, 6) as share from f union all select r_name, l_returnflag, round(v / sum(v) over (partition by r_name) * 100, 6) from s""",
    "stack_composition": f"""with {PLACED_SQL}, s as (select l_linenumber, n_name, sum(l_quantity) as v from placed group by 1, 2),
r as (select *, row_number() over (partition by l_linenumber order by v desc, n_name) as k, sum(v) over (partition by l_linenumber) as t from s)
select l_linenumber, case when k <= 4 then n_name else 'others' end as n_name, min(k) as place, round(sum(v) / any_value(t) * 100, 6) as share from r group by 1, 2""",
    "margin_opacity": f"with {POLLS_SQL} select event_id, round(least(1.0, greatest(0.5, 0.55 + 0.45 * (1 - exp(-abs(pct - 50) / 10)))), 6) as opacity from polls",
    "source_kinds": "select o_orderkey, case when o_orderkey % 5 = 0 then 'wiki' when o_orderstatus = 'P' then 'live' when o_orderstatus = 'F' then 'nec' else 'none' end as source from orders",
    "neighbours_in_time": "select o_orderkey, lag(o_orderkey) over w as previous, lead(o_orderkey) over w as next from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "highest_title": """with n as (select o_custkey, o_orderpriority, count(*) as terms from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1, 2)
select * from n qualify row_number() over (partition by o_custkey order by o_orderpriority) = 1""",
    "tie_broken": """with c as (select c_custkey as k, c_custkey % 200 as name, c_mktsegment as kind, c_mktsegment || c_nationkey as place from customer),
f as (select s_suppkey % 70 as name, case when s_suppkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end as kind, cast(s_nationkey as varchar) as place, s_suppkey as born from supplier),
g as (select k, count(*) as n, min(born) as b, count(*) filter (c.kind = f.kind) as m, min(born) filter (c.kind = f.kind) as o, min(born) filter (c.kind = f.kind and contains(c.place, f.place)) as p from c join f using (name) group by 1)
select c.k, case when n = 1 then b when m = 1 then o else p end as born from c left join g on c.k = g.k""",
    "ring_measures": "select cast(n_nationkey as bigint) as zone, cast(288 as double) as area, cast(n_nationkey * 37 % 100 as double) as x, cast(n_nationkey * 53 % 100 as double) as y from nation",
    "points_in_zones": """with z as (select n_nationkey as zone, n_nationkey * 37 % 100 as cx, n_nationkey * 53 % 100 as cy from nation), p as (select p_partkey, p_partkey * 17 % 101 + 0.25 as x, p_partkey * 29 % 103 + 0.35 as y from part)
select p_partkey, cast(min(zone) as bigint) as zone from p left join z on abs(x - cx) + abs(y - cy) < 12 group by 1""",
}

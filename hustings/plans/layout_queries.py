"""Queries over places, words of pages, calendars and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import calendar, text
from hustings.operators import audit, extraction, filters, joins, layout, resolve
from hustings.plans.tables import POLLS_SQL, polls, table


def _cells(spark, sf_dir):
    """Parts on a grid: column and row by arithmetic on the key, the brand as group; one cell a place."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_partkey") * 7 % 60).cast("long").alias("c"), F.floor(F.col("p_partkey") * 13 / 50 % 40).cast("long").alias("r"))
    return p.groupBy("c", "r").agg(F.min("p_partkey").alias("key"), F.min_by(F.floor(F.col("p_size") / 20), "p_partkey").cast("long").alias("zone"))


CELLS_SQL = """cells as (select c, r, min(p_partkey) as key, cast(floor(arg_min(p_size, p_partkey) / 20.0) as bigint) as zone from
  (select p_partkey, p_size, p_partkey * 7 % 60 as c, cast(floor((p_partkey * 13 / 50.0) % 40) as bigint) as r from part) group by c, r)"""
NEAR_SQL = f"""{CELLS_SQL}, steps as (select * from (values (0, 1, 0), (0, -1, 0), (0, 0, -1), (0, -1, -1), (0, 0, 1), (0, -1, 1), (1, 1, 0), (1, -1, 0), (1, 0, -1), (1, 1, -1), (1, 0, 1), (1, 1, 1)) s(odd, dc, dr)),
near as (select cells.*, c + dc as nc, r + dr as nr from cells join steps on odd = r % 2)"""


def hex_neighbours(spark, sf_dir):
    return layout.neighbours(_cells(spark, sf_dir)).select("key", "nc", "nr")


def hex_distance(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return c.select("key", layout.hex_distance(F.col("c"), F.col("r"), F.lit(10).cast("long"), F.lit(7).cast("long")).alias("steps"))


def hex_pixels(spark, sf_dir):
    x, y = layout.pixel(F.col("c"), F.col("r"), 10.0)
    return _cells(spark, sf_dir).select("key", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def border_edges(spark, sf_dir):
    return layout.borders(_cells(spark, sf_dir), "zone")


def grid_holes(spark, sf_dir):
    return layout.holes(_cells(spark, sf_dir), 3)


def adjacency_f1(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    found = layout.adjacency(cells, "key")
    truth = layout.adjacency(cells.filter("zone < 2"), "key")
    out = layout.agreement(found, truth, ["a", "b"])
    return out.select("both", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def grid_components(spark, sf_dir):
    return layout.grid_components(_cells(spark, sf_dir), "zone").select("c", "r", "component")


def line_grouping(spark, sf_dir):
    return layout.lines(table(spark, sf_dir, "events"), ["user_id"], "value", 3.0, ["event_id"]).select("event_id", "line")


def anchor_assignment(spark, sf_dir):
    e = polls(spark, sf_dir).select("event_id", "user_id", "pct")
    anchors = polls(spark, sf_dir).filter("k % 7 = 0 AND party = 'click'").select("user_id", F.floor("pct").cast("double").alias("at")).distinct()
    counts = polls(spark, sf_dir).filter("k % 7 = 1 AND party = 'view'").select("user_id", F.floor("pct").cast("double").alias("at")).distinct()
    return layout.anchored(e, anchors, ["user_id"], "pct", "at", 14, avoid=counts, apart=5).select("event_id", "anchor")


def layout_score(spark, sf_dir):
    """The parts' grid against a map that has some of its neighbours and the same order but for small shifts."""
    cells = _cells(spark, sf_dir).withColumns({"x": F.col("c") + F.col("key") % 5 + 0.01 * F.col("key"), "y": 0.01 * (F.col("key") % 300) - F.col("r")})
    truth = layout.adjacency(cells.filter("zone < 2"), "key")
    tests = cells.filter("key % 9 = 0").select(F.col("key").alias("a"), (F.col("key") + 9).alias("b"), F.when(F.col("key") % 2 == 0, "c").otherwise("r").alias("axis"))
    return layout.layout_score(cells, truth, "key", "zone", "x", "y", tests)


def greedy_align(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("x", F.col("pct"))
    return layout.greedy_alignment(p.filter("party = 'click'"), p.filter("party = 'view'"), ["user_id"], "x", "event_id", "pct")


def names_above(spark, sf_dir):
    """Clicks are anchors of a user's page, other events words at their value, the least k on top; names repeat."""
    p = polls(spark, sf_dir)
    words = p.filter("party <> 'click'").select("user_id", F.col("pct").alias("x"), F.col("k").alias("y"), F.concat(F.lit("n"), F.col("event_id") % 9).alias("t"))
    anchors = p.filter("party = 'click' AND k % 3 = 0").select("user_id", F.floor("pct").cast("double").alias("spot"))
    return extraction.names_above(words, anchors, ["user_id"], "x", "y", "t", "spot", 5.0)


def lane_pack(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), F.col("o_orderkey").cast("int") % 300).alias("b"))
    return layout.lanes(o, ["o_custkey"], "a", "b", "k").select("k", "lane")


def next_first_wednesday(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("term_end"))
    lead = F.when(F.col("o_orderkey") % 3 == 0, 70).when(F.col("o_orderkey") % 3 == 1, 50).otherwise(30)
    return calendar.predicted(o, "term_end", lead, F.lit(4), F.lit("2006-12-31").cast("date")).select("o_orderkey", F.col("nth").cast("long").alias("nth"), "election_day")


def phase_of_day(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.select("o_orderkey", calendar.phase(F.col("day"), F.lit("1998-06-03").cast("date")).alias("phase"))


def explode_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("name", "v")).select("event_id", "name", F.col("v").cast("long").alias("v"))


def range_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit("~"), F.col("p_size") + 18)).when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise("none").alias("t"))
    return p.select("p_partkey", text.range_bounds(F.col("t")).alias("b")).select("p_partkey", F.col("b.low").cast("long").alias("low"), F.col("b.high").cast("long").alias("high"))


def region_parse(spark, sf_dir):
    # full stops part words, they don't end the text
    d = table(spark, sf_dir, "documents").select("doc_id", text.region_parts(F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit(" "))).alias("p"))
    return d.filter("p.region RLIKE '^[A-Za-z]+$'").select("doc_id", "p.region", "p.unit")


def zip_careers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(", ", F.lit("t1"), F.concat(F.lit("t"), "p_size"), F.lit("t9")).alias("terms"), F.concat_ws("/", "p_brand", "p_type").alias("parties"), F.col("p_name").alias("districts"))
    z = p.select("p_partkey", F.posexplode(text.zipped_careers(F.col("terms"), F.col("parties"), F.col("districts"))).alias("n", "z"))
    return z.select("p_partkey", F.col("n").cast("long").alias("n"), "z.term", "z.party", "z.district")


def aggregate_or_sum(spark, sf_dir):
    g = polls(spark, sf_dir).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.round("pct").cast("double"))).alias("v"))
    v = F.when(F.col("user_id") % 2 == 0, F.array_append("v", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))).otherwise(F.col("v"))
    return g.select("user_id", "day", text.aggregate_or_sum(v).alias("total"))


def label_cascade(spark, sf_dir):
    e = polls(spark, sf_dir).select("event_id", filters.first_rule(F.concat_ws(" ", "party", "k"), [("1$|7$", "dk"), ("e", "neg"), ("i", "pos")]).alias("label"))
    return e


def answer_validation(spark, sf_dir):
    g = polls(spark, sf_dir).groupBy("user_id", "day").agg(F.sum(F.when(F.col("party") == "click", F.round("pct"))).alias("p"), F.sum(F.when(F.col("party") == "view", F.round("pct"))).alias("n"), F.sum(F.when(F.col("party") == "error", F.round("pct"))).alias("u"))
    return g.filter(text.valid_answer(F.col("p"), F.col("n"), F.col("u"))).select("user_id", "day")


def noise_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("w"))
    return d.filter(~text.noise_name(F.col("w"), ["the", "of", "die"], ["n", "er"], ["ch", "qu"], ["ll", "."], ["[aeiou]{3}", "^(.).?\\1$"], ["que"])).groupBy("lang", "w").agg(F.count("*").alias("n"))


def fused_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.fused(F.replace(F.col("p_name"), F.lit(" "), F.lit("")), ["bolt", "gear", "red", "hot"]).alias("f"))
    return p.filter("f IS NOT NULL").select("p_partkey", "f.name", "f.party")


def person_clusters(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    c = c.select("c_custkey", F.concat(F.lit("n"), F.col("c_custkey") % 60).alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 7).alias("birth"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 4).alias("script"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") % 6).alias("area"), F.when(F.col("c_custkey") % 9 != 0, F.lit(1950) + F.col("c_custkey") % 71).alias("year"))
    return resolve.person_clusters(c, "name", "c_custkey", "birth", "script", "area", "year")


def person_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("won", F.col("o_orderstatus") == "F").withColumn("area", F.substring("o_orderpriority", 1, 1)).withColumn("birth", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")))
    out = resolve.collapsed(o, ["o_custkey"], "o_totalprice", "won", "area", "birth", ["o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "won", F.array_join("areas", "").alias("areas"), "birth")


def person_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("won", F.col("o_orderstatus") == "F")
    out = resolve.summaries(o, "o_custkey", "won", "o_orderdate", "o_orderkey", "o_orderpriority", 3)
    return out.withColumn("parties", F.array_join("parties", "|"))


def lineage_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("name"), F.array(F.col("n_nationkey") + 1, F.col("n_nationkey") * 2).cast("array<long>").alias("next"), F.array(F.col("n_nationkey") - 1).cast("array<long>").alias("before"))
    return resolve.lineage_edges(n, "name", "next", "before")


def _findings(spark, sf_dir, shift=0):
    p = polls(spark, sf_dir).withColumn("pct", F.round("pct").cast("double") + shift).withColumn("unit", F.col("user_id") % 30)
    p = p.withColumn("name", F.when(F.col("k") % 50 == 0, F.col("party")).otherwise(F.col("event_id").cast("string"))).withColumn("expected", F.when(F.col("unit") % 2 == 0, F.lit("click")).otherwise(F.lit("view")))
    parties = p.select("party").distinct()
    return audit.together([
        audit.inflation(p, ["user_id", "day"], "party", ["click", "view"], 3), audit.party_as_name(p, "name", parties, "event_id"),
        audit.sum_sanity(p, ["user_id", "day"], "pct"), audit.office_mismatch(p, ["unit"], "party", "expected", ["event_id"]),
    ])


def audit_union(spark, sf_dir):
    return audit.counts(_findings(spark, sf_dir))


def audit_diff(spark, sf_dir):
    return audit.changes(_findings(spark, sf_dir), _findings(spark, sf_dir, 9).filter("severity <> 'error'"))


def audit_exit(spark, sf_dir):
    return audit.exit_code(_findings(spark, sf_dir))


def roster_gaps(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("name", F.floor("pct").cast("long"))
    s = p.withColumn("status", F.when(F.col("name") % 5 < 3, joins.REGISTERED).when(F.col("name") % 5 == 3, joins.ABSENT).otherwise(joins.UNKNOWN))
    return audit.roster_gaps(s, ["user_id", "day"], "name", "status")


def funnel_counts(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit.funnel(d, "doc_id", labels.filter("quality = 1"), labels, d.filter("n_chars < 200"))


def raw_completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return audit.completeness(d.select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (
        hex_neighbours, hex_distance, hex_pixels, border_edges, grid_holes, adjacency_f1, grid_components, line_grouping, anchor_assignment, layout_score, greedy_align, names_above, lane_pack,
        next_first_wednesday, phase_of_day, explode_json, range_parse, region_parse, zip_careers, aggregate_or_sum, label_cascade, answer_validation, noise_names,
        fused_tokens, person_clusters, person_collapse, person_summary, lineage_edges, audit_union, audit_diff, audit_exit, roster_gaps, funnel_counts, raw_completeness,
    )
}


def _found(name: str, shift: int = 0) -> str:
    return f"""p{name} as (select event_id, user_id, day, user_id % 30 as unit, party, round(pct) + {shift} as pct, case when k % 50 = 0 then party else cast(event_id as varchar) end as name,
  case when (user_id % 30) % 2 = 0 then 'click' else 'view' end as expected from polls),
o{name} as (select unit, party, count(*) as n, min(event_id) as f, any_value(expected) as expected from p{name} group by 1, 2),
{name} as (select 'party_inflation' as "check", 'error' as severity from p{name} where party in ('click', 'view') group by user_id, day, party having count(*) >= 3
  union all select 'party_as_name', 'error' from p{name} where name in (select party from p{name})
  union all select 'sum_sanity', 'warn' from p{name} group by user_id, day having sum(pct) < 30 or sum(pct) > 110
  union all select 'office_mismatch', 'warn' from (select * from o{name} qualify row_number() over (partition by unit order by n desc, f) = 1) where party <> expected)"""


WORDS_SQL = r"words as (select lang, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) as w from documents)"

ORACLE_SQL = {
    "hex_neighbours": f"with {NEAR_SQL} select key, nc, nr from near",
    "hex_distance": f"""with {CELLS_SQL}, d as (select key, (c - (r - r % 2) / 2) - (10 - (7 - 7 % 2) / 2) as dx, r - 7 as dz from cells)
select key, cast((abs(dx) + abs(dz) + abs(dx + dz)) / 2 as bigint) as steps from d""",
    "hex_pixels": f"with {CELLS_SQL} select key, round(10 * sqrt(3) * (c + 0.5 * (r % 2)), 6) as x, cast(round(15.0 * r, 6) as double) as y from cells",
    "border_edges": f"with {NEAR_SQL} select n.c, n.r, n.nc, n.nr, n.zone, o.zone as other from near n left join cells o on n.nc = o.c and n.nr = o.r where n.zone is distinct from o.zone",
    "grid_holes": f"with {NEAR_SQL} select nc, nr, count(*) as n from near where (nc, nr) not in (select c, r from cells) group by 1, 2 having count(*) >= 3",
    "adjacency_f1": f"""with {NEAR_SQL}, adj as (select n.key as a, o.key as b, n.zone < 2 and o.zone < 2 as inside from near n join cells o on n.nc = o.c and n.nr = o.r where n.key < o.key),
s as (select count(*) as f, count(*) filter (inside) as t from adj)
select t as "both", round(t / f, 6) as precision, cast(1 as double) as recall, round(2 * t / (f + t), 6) as f1 from s""",
    "grid_components": f"""with recursive {NEAR_SQL}, e as (select n.c * 1000000 + n.r as a, o.c * 1000000 + o.r as b from near n join cells o on n.nc = o.c and n.nr = o.r and n.zone = o.zone),
reach(a, b) as (select c * 1000000 + r, c * 1000000 + r from cells union select reach.a, e.b from reach join e on reach.b = e.a)
select a // 1000000 as c, a % 1000000 as r, min(b) as component from reach group by a""",
    "line_grouping": """with f as (select *, case when coalesce(value - lag(value) over (partition by user_id order by value, event_id) > 3.0, true) then 1 else 0 end as fresh from events)
select event_id, cast(sum(fresh) over (partition by user_id order by value, event_id rows unbounded preceding) as bigint) as line from f""",
    "layout_score": f"""with recursive {NEAR_SQL}, u as (select *, c + key % 5 + 0.01 * key as x, 0.01 * (key % 300) - r as y, c + 0.5 * (r % 2) as gx, r * sqrt(3.0) / 2 as gy from cells),
j as materialized (select n.key as a, o.key as b, n.zone as ga, o.zone as gb from near n join cells o on n.nc = o.c and n.nr = o.r), adj as (select a, b, ga < 2 and gb < 2 as inside from j where a < b),
reach(a, b) as (select key, key from cells union select reach.a, j.b from reach join j on reach.b = j.a where ga = gb), comps as (select zone, count(distinct least) as n from (select a, min(b) as least from reach group by 1) q join cells on a = key group by 1),
ga as (select distinct least(ga, gb) as a, greatest(ga, gb) as b, ga < 2 and gb < 2 as inside from j where ga <> gb),
m as (select zone, avg(x) as x, avg(y) as y, avg(gx) as gx, avg(gy) as gy from u group by 1),
rm as (select corr(row_number_x, row_number_gx) as cx, corr(row_number_y, row_number_gy) as cy from (select row_number() over (order by x, zone) as row_number_x, row_number() over (order by gx, zone) as row_number_gx, row_number() over (order by y, zone) as row_number_y, row_number() over (order by gy, zone) as row_number_gy from m)),
ru as (select corr(a, b) as cx, corr(c, d) as cy from (select row_number() over (order by x, key) as a, row_number() over (order by gx, key) as b, row_number() over (order by y, key) as c, row_number() over (order by gy, key) as d from u)),
h as (select count(*) as n from (select 1 from near where (nc, nr) not in (select c, r from cells) group by nc, nr having count(*) >= 4)),
o as (select count(*) as n, sum(cast((p.x > q.x) = (p.c > q.c) as int) + cast((p.y > q.y) = (p.r < q.r) as int)) as s from adj join u p on p.key = a join u q on q.key = b where inside),
t as (select count(*) as n, count(*) filter (case when p.key % 2 = 0 then p.c < q.c else p.r < q.r end) as s from u p join u q on q.key = p.key + 9 where p.key % 9 = 0),
s as (select 'connected' as measure, 30 * cast(max(n) = 1 as int) as points from comps
  union all select 'group_adjacency', floor(15 * 2.0 * count(*) filter (inside) / (count(*) + count(*) filter (inside))) from ga
  union all select 'adjacency', floor(25 * (2.0 * count(*) filter (inside) / (count(*) + count(*) filter (inside)))) from adj
  union all select 'group_order', floor((greatest(0, cx) + greatest(0, -cy)) / 2 * 10) from rm union all select 'order', floor((greatest(0, cx) + greatest(0, -cy)) / 2 * 10) from ru
  union all select 'holes', greatest(0, 10 - n) from h union all select 'pairs', floor(s / (2 * n) * 10) from o union all select 'tests', floor(s / n * 10) from t)
select measure, cast(points as bigint) as points from s union all select 'total', cast(sum(points) as bigint) from s""",
    "anchor_assignment": f"""with {POLLS_SQL}, a as (select distinct user_id, floor(pct) as place from polls where k % 7 = 0 and party = 'click'), v as (select distinct user_id, floor(pct) as place from polls where k % 7 = 1 and party = 'view'),
n as (select event_id, exists (select 1 from v where v.user_id = polls.user_id and abs(polls.pct - v.place) < 5) as beside from polls)
select polls.event_id, case when not beside then place end as anchor from polls join n using (event_id) left join a on polls.user_id = a.user_id and abs(pct - place) <= 14 qualify row_number() over (partition by polls.event_id order by abs(pct - place), place) = 1""",
    "names_above": f"""with recursive {POLLS_SQL}, a as materialized (select user_id, cast(floor(pct) as double) as spot, row_number() over (partition by user_id order by floor(pct), event_id) as i from polls where party = 'click' and k % 3 = 0),
w as materialized (select user_id, pct as x, k as y, 'n' || event_id % 9 as t from polls where party <> 'click'),
r(user_id, i, taken) as (select distinct user_id, cast(0 as bigint), cast([] as varchar[]) from a
  union all select r.user_id, r.i + 1, list_append(any_value(taken), arg_min(t, (y, x, t))) from r join a on a.user_id = r.user_id and a.i = r.i + 1
    left join w on w.user_id = r.user_id and abs(x - spot) <= 5 and not list_contains(list_filter(taken, lambda z: z is not null), t) group by r.user_id, r.i)
select a.user_id, spot, taken[a.i] as t from a join (select user_id, arg_max(taken, i) as taken from r group by 1) f on f.user_id = a.user_id where taken[a.i] is not null""",
    "lane_pack": """with recursive o as (select o_orderkey as k, o_custkey as c, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 300 as int) as b from orders),
n as (select *, row_number() over (partition by c order by a, k) as i from o),
r(c, i, k, lane, ends) as (select c, i, k, cast(0 as bigint), [b] from n where i = 1 union all
  select c, i, k, case when free > 0 then free - 1 else len(ends) end, case when free > 0 then list_transform(ends, lambda e, j: case when j = free then b else e end) else list_append(ends, b) end
  from (select n.c, n.i, n.k, n.b, r.ends, coalesce(list_position(list_transform(r.ends, lambda e: e <= n.a), true), 0) as free from r join n on n.c = r.c and n.i = r.i + 1))
select k, lane from r""",
    "greedy_align": f"""with recursive {POLLS_SQL}, l as (select user_id, event_id, pct as x, row_number() over (partition by user_id order by pct, event_id) as i from polls where party = 'click'),
f as (select user_id, list_sort(list(pct)) as free from polls where party = 'view' group by 1),
r(user_id, i, event_id, pct, free) as (select user_id, cast(0 as bigint), cast(null as bigint), cast(null as double), free from f union all
  select user_id, i, event_id, best, list_filter(free, lambda v, j: j <> list_position(free, best))
  from (select l.user_id, l.i, l.event_id, r.free, list_sort(list_transform(r.free, lambda v: {{'d': abs(v - l.x), 'v': v}}))[1].v as best from r join l on l.user_id = r.user_id and l.i = r.i + 1 where len(r.free) > 0))
select user_id, event_id, pct from r where i > 0""",
    "next_first_wednesday": """with o as (select o_orderkey, cast(o_orderdate as date) - case o_orderkey % 3 when 0 then 70 when 1 then 50 else 30 end as f from orders),
y as (select o_orderkey, f, unnest(generate_series(0, 12, 4)) as y from o), d as (select o_orderkey, y, cast(f + to_years(cast(y as int)) as date) as x from y),
w as (select o_orderkey, y, x + cast((9 - isodow(x) + 1) % 7 as int) as election_day from d)
select o_orderkey, y // 4 as nth, election_day from w where election_day <= date '2006-12-31'""",
    "phase_of_day": """with d as (select o_orderkey, date '1998-06-03' - cast(o_orderdate as date) as l from orders)
select o_orderkey, case when l = 0 then 'ELECTION' when l between 1 and 6 then 'BLACKOUT' when l between 7 and 14 then 'CAMPAIGN' when l > 14 then 'PRE' when l >= -30 then 'POST' when l >= -365 then 'RECENT' else 'ARCHIVED' end as phase from d""",
    "explode_json": "select event_id, 'k' as name, cast(json_extract_string(props, '$.k') as bigint) as v from events where json_extract_string(props, '$.k') is not null",
    "range_parse": "select p_partkey, cast(case when p_size % 3 < 2 then p_size end as bigint) as low, cast(case p_size % 3 when 0 then p_size + 18 when 1 then p_size end as bigint) as high from part",
    "region_parse": r"""with d as (select doc_id, string_split(trim(regexp_replace(replace(coalesce(text, ''), '.', ' '), '\s+', ' ', 'g')), ' ') as w from documents)
select doc_id, w[1] as region, coalesce(w[2], '') as unit from d where regexp_full_match(w[1], '[A-Za-z]+')""",
    "zip_careers": """with z as (select p_partkey, unnest([0, 1, 2]) as n, p_size, p_brand, p_type, p_name from part)
select p_partkey, cast(n as bigint) as n, case n when 0 then 't1' when 1 then 't' || p_size else 't9' end as term, case n when 0 then p_brand else p_type end as party, p_name as district from z""",
    "aggregate_or_sum": f"""with {POLLS_SQL}, g as (select user_id, day, list_sort(list(round(pct))) as v0 from polls group by all), h as (select user_id, day, case when user_id % 2 = 0 then list_append(v0, list_sum(v0)) else v0 end as v from g)
select user_id, day, case when len(v) > 1 and len(list_filter(v, lambda x: abs(2 * x - list_sum(v)) < 1.2)) > 0 then list_filter(v, lambda x: abs(2 * x - list_sum(v)) < 1.2)[1] else list_sum(v) end as total from h""",
    "label_cascade": f"with {POLLS_SQL} select event_id, case when regexp_matches(party || ' ' || k, '1$|7$') then 'dk' when contains(party, 'e') then 'neg' when contains(party, 'i') then 'pos' end as label from polls",
    "answer_validation": f"""with {POLLS_SQL}, g as (select user_id, day, sum(round(pct)) filter (party = 'click') as p, sum(round(pct)) filter (party = 'view') as n, sum(round(pct)) filter (party = 'error') as u from polls group by all)
select user_id, day from g where case when u is not null then p + n + u between 97 and 103 else p + n between 80 and 100 end""",
    "noise_names": rf"with {WORDS_SQL} select lang, w, count(*) as n from words where regexp_full_match(w, '\pL{{2,4}}') and w not in ('the', 'of', 'die') and not suffix(w, 'n') and not suffix(w, 'er') and not prefix(w, 'ch') and not prefix(w, 'qu') and not contains(w, 'll') and not regexp_matches(w, '[aeiou]{{3}}') and not (length(w) in (2, 3) and w[1] = w[-1]) and not (contains(w, 'que') and length(w) > 3) group by all",
    "fused_tokens": """with t as (select p_partkey, replace(p_name, ' ', '') as t from part), p as (select * from (values ('bolt'), ('gear'), ('red'), ('hot')) v(p)),
c as (select p_partkey, t, p, suffix(t, p) as ends from t join p on length(t) >= 5 and length(t) - length(p) between 2 and 4 and (suffix(t, p) or starts_with(t, p)))
select p_partkey, case when ends then left(t, length(t) - length(p)) else right(t, length(t) - length(p)) end as name, p as party from c
qualify row_number() over (partition by p_partkey order by length(p) desc, p desc, ends desc) = 1""",
    "person_clusters": """with recursive c as (select c_custkey as id, 'n' || (c_custkey % 60) as name, case when c_custkey % 3 <> 0 then c_custkey % 7 end as b, case when c_custkey % 5 = 0 then c_custkey % 4 end as s,
  case when c_custkey % 4 <> 0 then c_nationkey % 6 end as a, case when c_custkey % 9 <> 0 then 1950 + c_custkey % 71 end as y from customer),
e as (select p.id as u, q.id as v from c p join c q on p.name = q.name and p.id <> q.id where not coalesce(p.b <> q.b, false) and not coalesce(p.s <> q.s, false)
  and (coalesce(p.b = q.b, false) or coalesce(p.s = q.s, false) or (p.a = q.a and abs(p.y - q.y) <= 16))),
reach(u, v) as (select id, id from c union select reach.u, e.v from reach join e on reach.v = e.u),
l as (select u as id, min(v) as label from reach group by 1), k as (select c.*, label, count(distinct b) over (partition by label) as births from c join l using (id))
select id as c_custkey, min(id) over (partition by label, case when births > 1 then coalesce(cast(b as varchar), '?') else '' end) as person from k""",
    "person_collapse": """select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey, bool_or(o_orderstatus = 'F') as won, string_agg(distinct left(o_orderpriority, 1), '' order by left(o_orderpriority, 1)) as areas,
  min(o_orderdate) filter (o_orderkey % 3 = 0) as birth from orders group by 1""",
    "person_summary": """with f as (select o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) as t from orders group by 1, 2),
r as (select *, row_number() over (partition by o_custkey order by t) as k from f), p as (select o_custkey, string_agg(o_orderpriority, '|' order by k) as parties from r where k <= 3 group by 1)
select o_custkey, count(*) as races, count(*) filter (o_orderstatus = 'F') as wins, count(*) filter (o_orderstatus <> 'F') as losses, any_value(parties) as parties from orders join p using (o_custkey) group by 1""",
    "lineage_edges": """with n as (select cast(n_nationkey as bigint) as k from nation), e as (select k as source, k + 1 as target from n union select k, k * 2 from n union select k - 1, k from n)
select source, target from e where source in (select k from n) and target in (select k from n)""",
    "audit_union": f"""with {POLLS_SQL}, {_found('f')} select "check", severity, count(*) as count from f group by all""",
    "audit_diff": f"""with {POLLS_SQL}, {_found('f')}, {_found('g', 9)}, a as (select "check", count(*) as n from f group by 1), b as (select "check", count(*) as n from g where severity <> 'error' group by 1)
select coalesce(a."check", b."check") as "check", coalesce(a.n, 0) as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a."check" = b."check" """,
    "audit_exit": f"with {POLLS_SQL}, {_found('f')} select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warn') as warnings, case when count(*) filter (severity = 'error') > 0 then 1 else 0 end as exit_code from f",
    "roster_gaps": f"""with {POLLS_SQL}, s as (select *, cast(floor(pct) as bigint) as name from polls), g as (select user_id, day, count(*) as n, count(*) filter (name % 5 < 3) as reg from s group by all),
a as (select name, count(*) as n, sum(reg) / sum(g.n) as ratio from s join g using (user_id, day) where name % 5 = 3 group by 1)
select 'roster_gap' as "check", 'warn' as severity, cast(name as varchar) as key, cast(n as varchar) as value from a where n >= 3 and ratio >= 0.5""",
    "funnel_counts": """with d as (select doc_id, n_chars < 200 as i, doc_id in (select doc_id from labels where quality = 1) as p, doc_id in (select doc_id from labels) as r from documents)
select case when p and r then 'ok' when p then 'leak' when i then 'image' when r then 'parse_fail' else 'no_result' end as class, count(*) as n from d group by 1""",
    "raw_completeness": "select source, count(*) as listed, count(*) filter (doc_id not in (select doc_id from labels)) as missing from documents group by 1",
}

"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import dedup, joins, ranking
from hustings.plans.tables import PLACED_SQL, POLLS_SQL, POS, placed, polls, table

ERAS = [(0, "1990-01-01", "1996-06-30", "first"), (1, "1996-07-01", "1998-12-31", "second"), (2, "1999-03-01", None, "third")]


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def backfill_anti(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return joins.backfill(have, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0.0).alias("v")), ["k"])


def pending_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.pending(orders, results, "k")


def set_diff_both(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority < '3'").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").filter("c_mktsegment > 'C'").select(F.col("c_custkey").alias("k"))
    return joins.set_differences(o, c, ["k"])


def reconcile_full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("note"), "c_acctbal")
    new = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("note"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return joins.reconcile(old, new, ["k"], ["note"])


def priority_coalesce_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    own = dedup.mode(o.filter("o_orderstatus = 'F'"), ["c_custkey"], "o_orderpriority", ["o_orderkey"]).select("c_custkey", F.when(F.col("n") >= 2, F.col("o_orderpriority")).otherwise("").alias("v"))
    any_ = dedup.mode(o, ["c_custkey"], "o_orderpriority", ["o_orderkey"]).filter("n >= 3").select("c_custkey", F.col("o_orderpriority").alias("v"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("v"))
    return joins.priority_lookup(c, [(own, ["c_custkey"], "v"), (any_, ["c_custkey"], "v"), (nation, ["c_nationkey"], "v")], "party")


def roster_three_state(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    roster = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") % 4 == 1).alias("there"))
    return joins.roster_status(s, roster, ["s_nationkey"], "there")


def asof_era(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    eras = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("o_custkey"), F.col("l_shipdate").alias("t")).agg(F.min("l_returnflag").alias("era"))
    return joins.as_of(orders, eras, ["o_custkey"], "o_orderdate", "t", "era").select("o_orderkey", "era")


def interval_term(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    terms = _values(spark, ERAS, "n int, start string, stop string, holder string").select(F.to_date("start").alias("start"), F.to_date("stop").alias("stop"), "holder")
    out = joins.within_term(orders, terms, "day", "start", "stop", ["holder"])
    return out.select("o_orderkey", F.coalesce("holder", F.lit("")).alias("holder"))


def name_by_date(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.col("o_orderstatus").alias("party")).agg(F.count("*").alias("n"))
    eras = _values(spark, [("F", "1997-01", "F-one"), ("F", "1999-06", "F-two"), ("F", None, "F-now"), ("O", "1996-03", "O-one")], "party string, upper string, name string")
    return joins.name_by_upper_bound(rows, eras, "party", "ym", "upper", "name")


def ordered_fallback_match(spark, sf_dir):
    # small parts against all others; not split by brand, which is a rule's key
    parts = table(spark, sf_dir, "part").withColumn("small", F.coalesce(F.col("p_size") <= 25, F.lit(False)))
    left = parts.filter("small").select("p_partkey", "p_name", "p_brand", "p_type")
    right = parts.filter("NOT small")
    right = right.groupBy("p_name", "p_brand", "p_type").agg(F.min("p_partkey").alias("match"))
    rules = [
        left.join(right, ["p_name", "p_brand"]).groupBy("p_partkey").agg(F.min("match").alias("match")),
        left.join(right.groupBy("p_name", "p_type").agg(F.min("match").alias("match")), ["p_name", "p_type"]).select("p_partkey", "match"),
        left.join(right.groupBy("p_name").agg(F.min("match").alias("match")), ["p_name"]).select("p_partkey", "match"),
    ]
    return joins.ordered_match(left.select("p_partkey"), ["p_partkey"], rules)


def contains_longest_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.substring("p_brand", 1, 7).alias("zone"))
    words = parts.select("zone", F.explode(F.concat(F.split("p_name", " "), F.array(F.lit("e"), F.lit("re")))).alias("base")).filter("length(base) < 6").distinct()
    return joins.longest_contained(parts, "p_name", words, "base", ["zone"]).select("p_partkey", "base")


def candidate_keys(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    keys = F.array(F.concat("p_name", F.lit("!")), F.upper("p_name"), F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1))
    words = table(spark, sf_dir, "part").filter("p_size < 10").groupBy(F.substring_index("p_name", " ", 1).alias("word")).agg(F.min("p_partkey").alias("found"))
    return joins.first_key_that_matches(parts, keys, words, "word", "found").select("p_partkey", "found", F.col("used").cast("long").alias("used"))


def positional_zip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("a"))
    b = o.filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("b"))
    return joins.positional(a, b, ["o_custkey"], ["a"], ["b"]).select("o_custkey", "a", "b", F.col("place").cast("long").alias("place"))


def consensus_check(spark, sf_dir):
    p = polls(spark, sf_dir).filter("pct <= 100")
    month = F.date_format("day", "yyyy-MM")
    reference = p.filter("party < 'p'").groupBy("party", month.alias("month")).agg(F.round(F.avg("pct"), 6).alias("mean"))
    return joins.consensus(p.select("event_id", "party", "day", "pct"), ["party"], month, "pct", reference, 20).select("event_id", "party", "pct")


def hit_rate(spark, sf_dir):
    p = placed(spark, sf_dir)
    predicted = ranking.best_per_group(p.filter("l_linenumber <= 3"), ["l_orderkey", "l_returnflag"], "l_quantity", POS, ["n_name", "l_quantity"])
    actual = ranking.best_per_group(p, ["l_orderkey"], "l_quantity", POS, ["n_name", "l_quantity"])
    out = joins.hit_rate(predicted, actual, ["l_orderkey"], ["l_returnflag"], "n_name", "l_quantity")
    return out.select("l_returnflag", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("mae", 6).alias("mae"))


def alias_resolution(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    life = [("click", "2024-01-10", None, "view", None), ("view", None, "2024-01-20", None, "purchase"), ("purchase", "2024-01-05", None, None, None)]
    life = _values(spark, life, "name string, since string, until string, before_as string, after_as string").withColumns({"since": F.to_date("since"), "until": F.to_date("until")})
    return joins.resolve_aliases(e, life, "event_type", "day", rounds=4).select("event_id", "resolved")


QUERIES = {
    f.__name__: f
    for f in (
        backfill_anti, pending_rows, set_diff_both, reconcile_full_outer, priority_coalesce_join, roster_three_state, asof_era, interval_term, name_by_date,
        ordered_fallback_match, contains_longest_match, candidate_keys, positional_zip, consensus_check, hit_rate, alias_resolution,
    )
}

TERMS_SQL = "terms as (select * from (values (date '1990-01-01', date '1996-06-30', 'first'), (date '1996-07-01', date '1998-12-31', 'second'), (date '1999-03-01', null, 'third')) t(start, stop, holder))"
WINNER = "l_quantity desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

ORACLE_SQL = {
    "backfill_anti": "select l_orderkey as k, sum(l_quantity) as v from lineitem group by 1 union all select o_orderkey, 0 from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "pending_rows": "select o_orderkey as k, o_orderstatus, n, n is null as is_pending from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey",
    "set_diff_both": """with a as (select distinct o_custkey as k from orders where o_orderpriority < '3'), b as (select c_custkey as k from customer where c_mktsegment > 'C')
select k, 'left' as only_in from (from a except from b) union all select k, 'right' from (from b except from a)""",
    "reconcile_full_outer": """with o as (select c_custkey as k, case when c_custkey % 2 = 0 then '' else c_mktsegment end as note, c_acctbal from customer where c_custkey % 3 <> 0),
n as (select c_custkey as k, lower(c_mktsegment) as note, c_acctbal + 1 as c_acctbal from customer where c_custkey % 5 <> 0)
select coalesce(o.k, n.k) as k, case when n.k is not null and coalesce(o.note, '') = '' then n.note else o.note end as note,
  case when n.k is not null then n.c_acctbal else o.c_acctbal end as c_acctbal, case when n.k is null then 'kept' when o.k is null then 'added' else 'updated' end as state
from o full join n on o.k = n.k""",
    "priority_coalesce_join": """with g as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as f, count(*) filter (o_orderstatus = 'F') as nf, min(o_orderkey) filter (o_orderstatus = 'F') as ff from orders group by 1, 2),
own as (select o_custkey, o_orderpriority, nf as n from g where nf > 0 qualify row_number() over (partition by o_custkey order by nf desc, ff) = 1),
anyp as (select o_custkey, o_orderpriority, n from g qualify row_number() over (partition by o_custkey order by n desc, f) = 1)
select c_custkey, c_nationkey, coalesce(case when own.n >= 2 then own.o_orderpriority end, case when anyp.n >= 3 then anyp.o_orderpriority end, n_name) as party
from customer left join own on own.o_custkey = c_custkey left join anyp on anyp.o_custkey = c_custkey left join nation on n_nationkey = c_nationkey""",
    "roster_three_state": "select s_suppkey, s_nationkey, case s_nationkey % 4 when 0 then 'unknown' when 1 then 'registered' else 'absent' end as status from supplier",
    "asof_era": """with e as (select l_suppkey as k, l_shipdate as t, min(l_returnflag) as era from lineitem where l_linenumber = 1 group by all)
select o_orderkey, era from orders asof left join e on o_custkey = k and o_orderdate >= t""",
    "interval_term": f"with {TERMS_SQL} select o_orderkey, coalesce(holder, '') as holder from orders left join terms on cast(o_orderdate as date) >= start and (stop is null or cast(o_orderdate as date) <= stop)",
    "name_by_date": """with r as (select strftime(o_orderdate, '%Y-%m') as ym, o_orderstatus as party, count(*) as n from orders group by all)
select ym, party, n, case when party = 'F' then case when ym < '1997-01' then 'F-one' when ym < '1999-06' then 'F-two' else 'F-now' end when party = 'O' and ym < '1996-03' then 'O-one' else party end as name_then from r""",
    "ordered_fallback_match": """with l as (select p_partkey, p_name, p_brand, p_type from part where p_size <= 25), r as (select * from part where p_size is null or p_size > 25),
c as (select l.p_partkey, 0 as rule, min(r.p_partkey) as match from l join r using (p_name, p_brand) group by 1 union all
  select l.p_partkey, 1, min(r.p_partkey) from l join r using (p_name, p_type) group by 1 union all select l.p_partkey, 2, min(r.p_partkey) from l join r using (p_name) group by 1)
select l.p_partkey, rule, match from l left join (select * from c qualify row_number() over (partition by p_partkey order by rule) = 1) using (p_partkey)""",
    "contains_longest_match": """with p as (select p_partkey, p_name, substr(p_brand, 1, 7) as zone from part),
w as (select distinct zone, unnest(string_split(p_name, ' ') || ['e', 're']) as base from p), s as (select * from w where length(base) < 6)
select p.p_partkey, base from p left join s on p.zone = s.zone and contains(p_name, base) qualify row_number() over (partition by p.p_partkey order by length(base) desc nulls last, base) = 1""",
    "candidate_keys": """with w as (select split_part(p_name, ' ', 1) as word, min(p_partkey) as found from part where p_size < 10 group by 1),
k as (select p_partkey, p_name || '!' as key, 0 as pos from part union all select p_partkey, upper(p_name), 1 from part
  union all select p_partkey, split_part(p_name, ' ', -1), 2 from part union all select p_partkey, split_part(p_name, ' ', 1), 3 from part),
h as (select p_partkey, found, pos from k join w on key = word qualify row_number() over (partition by p_partkey order by pos) = 1)
select p.p_partkey, found, cast(pos as bigint) as used from part p left join h on p.p_partkey = h.p_partkey""",
    "positional_zip": """with a as (select o_custkey, o_orderkey as a, row_number() over (partition by o_custkey order by o_orderkey) as place, count(*) over (partition by o_custkey) as n from orders where o_orderstatus = 'F'),
b as (select o_custkey, o_orderkey as b, row_number() over (partition by o_custkey order by o_orderkey) as place, count(*) over (partition by o_custkey) as n from orders where o_orderstatus = 'O')
select o_custkey, a, b, place from a join b using (o_custkey, place, n)""",
    "consensus_check": f"""with {POLLS_SQL}, f as (select * from polls where pct <= 100),
r as (select party, strftime(day, '%Y-%m') as month, round(avg(pct), 6) as mean from f where party < 'p' group by all)
select event_id, f.party, pct from f left join r on f.party = r.party and strftime(day, '%Y-%m') = month where mean is null or abs(pct - mean) <= 20""",
    "hit_rate": f"""with {PLACED_SQL}, p as (select * from placed where l_linenumber <= 3 qualify row_number() over (partition by l_orderkey, l_returnflag order by {WINNER}) = 1),
a as (select * from placed qualify row_number() over (partition by l_orderkey order by {WINNER}) = 1)
select p.l_returnflag, count(*) as n, round(avg(cast(p.n_name = a.n_name as int)), 6) as hit_rate, round(avg(abs(p.l_quantity - a.l_quantity)), 6) as mae from p join a using (l_orderkey) group by 1""",
    "alias_resolution": """with e as (select event_id, event_type as r, cast(ts as date) as day from events),
a as (select event_id, day, case when r = 'click' and day < date '2024-01-10' then 'view' when r = 'view' and day >= date '2024-01-20' then 'purchase' when r = 'purchase' and day < date '2024-01-05' then null else r end as r from e),
b as (select event_id, day, case when r = 'click' and day < date '2024-01-10' then 'view' when r = 'view' and day >= date '2024-01-20' then 'purchase' when r = 'purchase' and day < date '2024-01-05' then null else r end as r from a)
select event_id, r as resolved from b""",
}

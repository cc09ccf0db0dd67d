"""Filter and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import filters
from hustings.plans.tables import PLACED_SQL, POLLS_SQL, placed, polls, table

NOW = "2024-01-31"
MAJOR_A, MAJOR_B = ["click", "view"], ["purchase"]
REJECT = ["(?i)^is", "reedes", "[0-9]{4}"]
CLASSES = [("[0-9]{3}", "numbers"), ("(?i)^the", "article"), ("tion", "abstract"), ("er", "person")]


def _rows(spark, sf_dir):
    return polls(spark, sf_dir).withColumn("name", F.when(F.col("k") % 13 == 0, "").otherwise(F.floor(F.col("pct") / 3).cast("string"))).withColumn("pct", F.round("pct", 1))


ROWS_SQL = f"""{POLLS_SQL}, r as (select * replace (round(pct, 1) as pct), case when k % 13 = 0 then '' else cast(cast(floor(pct / 3) as bigint) as varchar) end as name from polls)"""
POLL = ["user_id", "day"]


def scale_repair(spark, sf_dir):
    p = _rows(spark, sf_dir).withColumn("pct", F.round(F.col("pct") * F.when(F.col("user_id") % 3 == 0, 7).otherwise(1)).cast("double"))
    return filters.scale_repair(p, POLL, "pct").select("event_id", "pct")


def over_sum_drop(spark, sf_dir):
    p = _rows(spark, sf_dir).withColumn("pct", F.round("pct").cast("double"))
    return filters.over_sum(p, POLL, "pct").select("event_id")


def both_present(spark, sf_dir):
    return filters.both_present(_rows(spark, sf_dir), POLL, "party", MAJOR_A, MAJOR_B).select("event_id")


def repeated_names(spark, sf_dir):
    return filters.repeated_names(_rows(spark, sf_dir).withColumn("name", F.col("party")), ["user_id", "day"], "name", share=0.8).select("event_id")


def crowded_party(spark, sf_dir):
    return filters.crowded_party(_rows(spark, sf_dir), ["user_id", "day"], "party", MAJOR_A, least=2).select("event_id")


def single_party_drop(spark, sf_dir):
    p = _rows(spark, sf_dir).withColumn("p", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("party")))
    return filters.single_party(p, POLL, "p", "view").select("event_id")


def multiway_filter(spark, sf_dir):
    p = _rows(spark, sf_dir).withColumn("pct", F.floor("pct").cast("double"))
    return filters.multiway(p, POLL, "name", "pct", least=3, low=60, high=300, top=120)


def mislabel_filter(spark, sf_dir):
    return filters.mislabelled(_rows(spark, sf_dir), POLL, "party", "purchase", "view").select("event_id")


def horse_race(spark, sf_dir):
    p = _rows(spark, sf_dir)
    roster = p.filter("agency < 4 AND name <> ''").select("name")
    return filters.horse_race(p, ["user_id"], "name", roster, ["1", "2", "3", "4", "5"], 20, 60).select("event_id")


def title_reject(spark, sf_dir):
    # whole texts; a null text is neither rejected nor accepted: no row
    d = table(spark, sf_dir, "documents")
    return d.filter(~filters.any_rule(F.col("text"), REJECT)).select("doc_id")


def classify_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", filters.first_rule(F.col("text"), CLASSES, "other").alias("label"))


def metric_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(filters.holds_any(F.col("p_name"), ["dwid", "ering", "otg", "kst"])).select("p_partkey")


def recency_window(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("seen", F.when(F.col("k") % 10 != 0, F.col("day")))
    return filters.recent(p, "seen", NOW, 7).select("event_id")


def period_window(spark, sf_dir):
    return filters.in_period(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "1998-04-15").select("o_orderkey")


def blackout_cutoff(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("seen", F.when(F.col("k") % 10 != 0, F.col("day")))
    return filters.before_blackout(p, "seen", "2024-01-25 00:00:00", "2024-02-01 00:00:00", "2024-01-28 12:00:00").select("event_id")


def embargo(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("after", F.when(F.col("k") % 5 != 0, F.col("ts")))
    return filters.quotable(p, "after", "2024-01-15 00:00:00").select("event_id")


def free_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return filters.free_text(c, ["c_mktsegment", "n_name"], "Y nat").select("c_custkey")


def search_tiered(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return filters.tiered_search(names, "p_name", "Re", ["first"]).select("p_name", F.col("tier").cast("long").alias("tier"))


def faceted_list(spark, sf_dir):
    rows, _ = filters.faceted(table(spark, sf_dir, "part"), {"p_brand": "Brand#11", "p_type": None}, [F.col("p_size").desc(), F.col("p_partkey")], 20)
    return rows.select("p_partkey", "p_size")


def faceted_total(spark, sf_dir):
    return filters.faceted(table(spark, sf_dir, "part"), {"p_brand": "Brand#11", "p_type": None}, [F.col("p_partkey")], 20)[1]


def admission_rule(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("won", F.when(F.col("l_linenumber") > 1, F.col("l_quantity") > 45))
    known = p.filter("l_quantity = 50 AND l_linenumber = 1").select("l_suppkey", "l_returnflag")
    return filters.admitted(p, "won", ["l_suppkey", "l_returnflag"], known, "l_partkey", "l_quantity", 30.0).groupBy("l_orderkey").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scale_repair, over_sum_drop, both_present, repeated_names, crowded_party, single_party_drop, multiway_filter, mislabel_filter, horse_race, title_reject,
        classify_cascade, metric_titles, recency_window, period_window, blackout_cutoff, embargo, free_text, search_tiered, faceted_list, faceted_total, admission_rule,
    )
}

ORACLE_SQL = {
    "scale_repair": f"""with {ROWS_SQL}, a as (select event_id, user_id, day, round(pct * case when user_id % 3 = 0 then 7 else 1 end) as pct from r),
b as (select *, case when sum(pct) over (partition by user_id, day) between 700 and 1100 then round(pct / 10, 1) else pct end as fixed from a),
c as (select *, sum(fixed) over (partition by user_id, day) as total from b) select event_id, fixed as pct from c where total between 30 and 110""",
    "over_sum_drop": f"with {ROWS_SQL} select event_id from r qualify sum(round(pct)) over (partition by user_id, day) <= 113",
    "both_present": f"with {ROWS_SQL} select event_id from r qualify bool_or(party in ('click', 'view')) over (partition by user_id, day) and bool_or(party = 'purchase') over (partition by user_id, day)",
    "repeated_names": f"with {ROWS_SQL}, g as (select user_id, day from r group by 1, 2 having count(*) >= 3 and count(distinct party) < 0.8 * count(*)) select event_id from r anti join g using (user_id, day)",
    "crowded_party": f"with {ROWS_SQL}, g as (select user_id, day from r where party in ('click', 'view') group by user_id, day, party having count(*) >= 2) select event_id from r where (user_id, day) not in (select user_id, day from g)",
    "single_party_drop": f"""with {ROWS_SQL}, q as (select *, case when k % 4 = 0 then '' else party end as p from r),
g as (select user_id, day, count(distinct p) filter (p not in ('', 'view')) as n, bool_or(p = 'view') as ind, bool_or(p <> '') as any_p from q group by 1, 2)
select event_id from q join g using (user_id, day) where any_p and not (n = 1 and not ind)""",
    "multiway_filter": f"""with {ROWS_SQL} select user_id, day, count(*) filter (name <> '') as n, sum(floor(pct)) as sum, max(floor(pct)) as max from r group by 1, 2
having count(*) filter (name <> '') >= 3 and sum(floor(pct)) between 60 and 300 and max(floor(pct)) < 120""",
    "mislabel_filter": f"with {ROWS_SQL}, f as (select *, bool_or(party = 'purchase') over (partition by user_id, day) as named from r) select event_id from f where not (named and party = 'view')",
    "horse_race": f"""with {ROWS_SQL}, o as (select * from r where name in (select name from r where agency < 4 and name <> ''))
select event_id from o qualify count(*) over (partition by user_id) between 20 and 60 and bool_or(name in ('1', '2', '3', '4', '5')) over (partition by user_id)""",
    "title_reject": "select doc_id from documents where not regexp_matches(text, '((?i)^is)|(reedes)|([0-9]{4})')",
    "classify_cascade": """select doc_id, case when regexp_matches(text, '[0-9]{3}') then 'numbers' when regexp_matches(text, '(?i)^the') then 'article' when contains(text, 'tion') then 'abstract'
  when contains(text, 'er') then 'person' else 'other' end as label from documents""",
    "metric_titles": "select p_partkey from part where regexp_matches(replace(p_name, ' ', ''), 'dwid|ering|otg|kst')",
    "recency_window": f"with {POLLS_SQL} select event_id from polls where not (k % 10 <> 0) or k is null or date '{NOW}' - day <= 7",
    "period_window": "select o_orderkey from orders where cast(o_orderdate as date) between date '1997-04-15' and date '1998-04-15'",
    "blackout_cutoff": f"with {POLLS_SQL} select event_id from polls where k % 10 <> 0 and day < date '2024-01-25'",
    "embargo": f"with {POLLS_SQL} select event_id from polls where not (k % 5 <> 0) or k is null or ts <= timestamp '2024-01-15'",
    "free_text": "select c_custkey from customer join nation on c_nationkey = n_nationkey where contains(lower(replace(c_mktsegment || n_name, ' ', '')), 'ynat')",
    "search_tiered": """with n as (select p_name, min(p_partkey) as first, case when lower(p_name) = 're' then 0 when starts_with(lower(p_name), 're') then 1 when contains(lower(p_name), 're') then 2 end as tier from part group by 1)
select p_name, cast(tier as bigint) as tier from n where tier is not null order by tier, first limit 6""",
    "faceted_list": "select p_partkey, p_size from part where p_brand = 'Brand#11' order by p_size desc, p_partkey limit 20",
    "faceted_total": "select count(*) as total from part where p_brand = 'Brand#11'",
    "admission_rule": f"""with {PLACED_SQL}, kn as (select distinct l_suppkey, l_returnflag from placed where l_quantity = 50 and l_linenumber = 1), m as (select l_partkey, count(*) as races from placed group by 1)
select l_orderkey, count(*) as n from placed join m using (l_partkey) left join (select *, true as known from kn) using (l_suppkey, l_returnflag)
where (l_linenumber > 1 and l_quantity > 45) or known or (races > 1 and l_quantity >= 30) group by 1""",
}

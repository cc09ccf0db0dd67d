"""Cleaning and deduplication queries over poll-like records."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import dedup
from hustings.plans.tables import POLLS_SQL, polls, table


def card_dedup(spark, sf_dir):
    p = polls(spark, sf_dir)
    return dedup.best_card(p, ["party", "day", "agency"], [F.col("k") % 7, F.floor(F.col("pct") / 10), F.col("k")], ["event_id"]).select("party", "day", "agency", "event_id")


def record_dedup(spark, sf_dir):
    e = polls(spark, sf_dir).withColumn("label", F.when(F.col("k") % 11 == 0, "").otherwise(F.col("party")))
    return dedup.max_by_label(e, ["day", "user_id"], ["label"], "pct", ["event_id"]).select("event_id", "label", "pct")


def signature_dedup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag")).withColumn("q", F.floor(F.col("l_quantity") / 10).cast("long"))
    return dedup.by_signature(li.withColumn("head", F.col("l_orderkey") % 3), ["l_orderkey"], ["head"], ["flag", "q"], ["l_orderkey"]).select("l_orderkey")


def majority_party(spark, sf_dir):
    return dedup.mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderkey"])


def qualified_majority(spark, sf_dir):
    return dedup.qualified_mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderkey"])


def distinct_source_support(spark, sf_dir):
    return dedup.supported(polls(spark, sf_dir).withColumn("name", F.floor("pct")), ["party", "name"], "agency", 2).select("party", F.col("name").cast("long").alias("name"), "n_sources")


def unique_value(spark, sf_dir):
    return dedup.unique_or_null(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


def source_priority_union(spark, sf_dir):
    p = polls(spark, sf_dir).select("event_id", "user_id", "day", "party")
    return dedup.first_source([p.filter("party = 'click'"), p.filter("party = 'view'"), p], ["user_id", "day"], ["event_id"])


def _names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("name"))
    return d.filter("name <> ''")


def name_snap(spark, sf_dir):
    n = _names(spark, sf_dir).withColumn("zone", F.substring("name", 1, 3))
    return dedup.snapped_names(n, ["lang", "zone"], "name", rare=10, most_names=40)


def bleed_repair(spark, sf_dir):
    return dedup.bleed_repair(_names(spark, sf_dir), ["lang"], "name")


def known_candidate_gate(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("name", F.when(F.col("k") % 9 == 0, "").otherwise(F.floor(F.col("pct") / 5).cast("string")))
    known = dedup.supported(p.filter("name <> ''"), ["name"], "agency", 12)
    return dedup.known_candidates(p, ["user_id", "day"], "name", known).select("event_id", "name")


def continuation_runs(spark, sf_dir):
    e = polls(spark, sf_dir)
    return dedup.continued(e, ["user_id"], ["ts", "event_id"], ["party"]).select("event_id", "run")


def agreement_merge(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("label", F.concat("party", F.lit("-"), F.floor(F.col("pct") / 40).cast("string")))
    return dedup.agreement_merge(p, ["day", "agency"], "user_id", "label", "pct", 5.0)


def keyed_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit(None).cast("string").alias("note"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("note"))
    second = o.select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("int").alias("c_nationkey"), F.lit(-1.0).alias("c_acctbal"), "note")
    out = dedup.keyed_merge([c, second], F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")), ["c_nationkey", "c_acctbal", "note"])
    return out


QUERIES = {
    f.__name__: f
    for f in (
        card_dedup, record_dedup, signature_dedup, majority_party, qualified_majority, distinct_source_support, unique_value, source_priority_union, name_snap,
        bleed_repair, known_candidate_gate, continuation_runs, agreement_merge, keyed_merge,
    )
}

WORDS_SQL = r"words as (select lang, unnest(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')) as name from documents)"

ORACLE_SQL = {
    "card_dedup": f"with {POLLS_SQL} select party, day, agency, event_id from polls qualify row_number() over (partition by party, day, agency order by k % 7 desc nulls last, floor(pct / 10) desc nulls last, k desc nulls last, event_id) = 1",
    "record_dedup": f"""with {POLLS_SQL}, l as (select *, case when k % 11 = 0 then '' else party end as label from polls)
select event_id, label, pct from l qualify label = '' or row_number() over (partition by day, user_id, label order by pct desc, event_id) = 1""",
    "signature_dedup": """with s as (select l_orderkey, l_orderkey % 3 as head, list_sort(list((l_returnflag, cast(floor(l_quantity / 10) as bigint)))) as sig from lineitem group by 1)
select min(l_orderkey) as l_orderkey from s group by head, sig""",
    "majority_party": """with g as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as f from orders group by 1, 2)
select o_custkey, o_orderpriority, n, cast(sum(n) over (partition by o_custkey) as bigint) as total from g qualify row_number() over (partition by o_custkey order by n desc, f) = 1""",
    "qualified_majority": """with g as (select o_custkey, o_orderstatus, count(*) as n, min(o_orderkey) as f from orders group by 1, 2),
t as (select *, cast(sum(n) over (partition by o_custkey) as bigint) as total from g qualify row_number() over (partition by o_custkey order by n desc, f) = 1) select o_custkey, o_orderstatus, n, total from t where n = total or n >= 2 * (total - n)""",
    "distinct_source_support": f"with {POLLS_SQL} select party, cast(floor(pct) as bigint) as name, count(distinct agency) as n_sources from polls group by all having count(distinct agency) >= 2",
    "unique_value": "select o_custkey, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) end as o_orderstatus from orders group by 1",
    "source_priority_union": f"""with {POLLS_SQL} select event_id, user_id, day, party from polls
qualify row_number() over (partition by user_id, day order by case party when 'click' then 0 when 'view' then 1 else 2 end, event_id) = 1""",
    "name_snap": f"""with {WORDS_SQL}, c as (select lang, substr(name, 1, 3) as zone, name, count(*) as n from words where name <> '' group by all),
t as (select *, first_value(name) over w as top, first_value(n) over w as top_n, count(*) over (partition by lang, zone) as names from c window w as (partition by lang, zone order by n desc, name))
select lang, zone, name, case when n < 10 and top_n >= 10 and names < 40 and abs(length(name) - length(top)) <= 1
  and (starts_with(name, top) or starts_with(top, name) or suffix(name, top) or suffix(top, name) or (length(name) = length(top) and len(list_filter(range(1, length(name) + 1), lambda i: substr(name, i, 1) <> substr(top, i, 1))) <= 1)) then top else name end as snapped from t""",
    "bleed_repair": f"""with {WORDS_SQL}, c as (select lang, name, count(*) as n from words where name <> '' group by all)
select a.lang, a.name, case when length(a.name) between 4 and 5 and b.n >= 2 and b.n > a.n then b.name else a.name end as repaired
from c a left join c b on a.lang = b.lang and b.name = left(a.name, length(a.name) - 1)""",
    "known_candidate_gate": f"""with {POLLS_SQL}, n as (select *, case when k % 9 = 0 then '' else cast(cast(floor(pct / 5) as bigint) as varchar) end as name from polls),
kn as (select name from n where name <> '' group by 1 having count(distinct agency) >= 12),
j as (select n.*, sum(case when n.name <> '' then 1 else 0 end) over w as named, sum(case when kn.name is not null then 1 else 0 end) over w as hits
  from n left join kn on n.name = kn.name window w as (partition by user_id, day))
select event_id, name from j where not (named >= 2 and hits < 2)""",
    "continuation_runs": f"""with {POLLS_SQL}, f as (select *, case when lag(party) over (partition by user_id order by ts, event_id) is distinct from party then 1 else 0 end as fresh from polls)
select event_id, cast(sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as run from f""",
    "keyed_merge": """with o as (select o_custkey, min(o_orderstatus) as note from orders where o_orderkey % 7 = 0 group by 1)
select c_custkey as key, c_nationkey, c_acctbal, note, cast(1 + case when o_custkey is null then 0 else 1 end as bigint) as n_rows from customer left join o on o_custkey = c_custkey where c_custkey % 10 <> 0""",
}

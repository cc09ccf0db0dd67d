"""Readers, sinks and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import trends
from hustings.plans.tables import POLLS_SQL, polls, table
from hustings.sources import paged, readers, sinks
from hustings.streaming import scans, twins
from hustings.workers import scratch


def unpivot_wide(spark, sf_dir):
    wide = polls(spark, sf_dir).groupBy("day", "agency").pivot("party", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("k"))
    return readers.unpivot(wide.withColumn("click", F.format_number("click", 0)), ["day", "agency"])


def numbered_unpivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cols = [F.max(F.when(F.col("l_linenumber") == i, F.col(c))).alias(f"{p}{i:02d}") for i in range(1, 8) for p, c in (("hbj", "l_suppkey"), ("dugsu", "l_quantity"))]
    return readers.numbered(li.groupBy("l_orderkey").agg(*cols), ["l_orderkey"], {"option": "hbj", "votes": "dugsu"}, 50).select("l_orderkey", F.col("pos").cast("long").alias("pos"), "option", "votes")


def pseudo_attributes(spark, sf_dir):
    e = polls(spark, sf_dir)
    wide, rest = readers.attributes(e, ["day", "agency"], "party", "k", {"electors": "signup", "voters": "view"})
    return wide.join(rest.groupBy("day", "agency").agg(F.sum("k").alias("votes"), F.count("*").alias("options")), ["day", "agency"], "left")


def subtotal_policy(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = readers.totals_or_parts(li.filter("l_returnflag <> 'R'"), "l_returnflag", ["R"], ["l_linestatus"], "l_quantity").withColumn("which", F.lit("parts"))
    b = readers.totals_or_parts(li, "l_returnflag", ["R"], ["l_linestatus"], "l_quantity").withColumn("which", F.lit("totals"))
    return a.unionByName(b)


def filled_down(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).otherwise("").alias("head"))
    return readers.filled_down(e, ["event_id"], "head", ["user_id"]).select("event_id", "head")


def chunk_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    path = scratch(spark, "chunks")
    sinks.split(li, path, sinks.chunk(F.col("l_returnflag"), F.col("l_linestatus"), {"O": ["A"]}))
    return readers.chunks(spark, path, f"{', '.join(f'{n} {t}' for n, t in li.dtypes)}, chunk string", ["drill"]).groupBy("chunk", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def upsert_preserving(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    old = c.filter("c_custkey % 2 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")))
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lower("c_mktsegment").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return sinks.upsert(old, new, ["c_custkey"], ["c_mktsegment"])


def overwrite_guard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sinks.guarded(o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus = 'P'"), ["o_custkey"])


def incremental_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return sinks.incremental(e.filter("event_type < 'p'"), e.withColumn("event_type", F.upper("event_type")), ["event_id"])


def file_catalog(spark, sf_dir):
    """Orders written in a file a priority; files are told apart by their paths."""
    folder = scratch(spark, "catalogue")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(folder)
    files = readers.catalogue(spark, folder, [(r"o_orderpriority=[12]-", "high"), (r"o_orderpriority=3-", "medium")])
    return readers.catalogue_summary(files).select("kind", "files")


def wiki_cells(spark, sf_dir):
    """Documents as wiki tables: sentences are rows, commas part cells, some words are links."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-zÀ-ÿ,. ]", "").alias("t"))
    rows = F.replace(F.replace(F.replace("t", F.lit(". "), F.lit("\n| ")), F.lit(", "), F.lit(" || ")), F.lit(" de "), F.lit(" [[x y|de]] "))
    w = readers.wiki_cells(d.select("doc_id", F.concat(F.lit("{|\n|-\n| "), rows, F.lit("\n|}")).alias("markup")), "markup")
    return w.select("doc_id", F.array_join("cells", "/").alias("cells"))


def xml_rows(spark, sf_dir):
    """Parts as XML, an item for each word of the name; some of it is cut off and has none."""
    item = lambda w: F.concat(F.lit("<item><name>"), w, F.lit("</name><v>"), F.col("p_size").cast("string"), F.lit("</v></item>"))
    xml = F.concat(F.lit("<r>"), F.array_join(F.transform(F.split("p_name", " "), item), ""), F.when(F.col("p_size") % 10 == 0, "<r").otherwise("</r>"))
    return readers.xml_rows(table(spark, sf_dir, "part").select("p_partkey", xml.alias("payload")), "payload", "item array<struct<name:string,v:bigint>>", "item").select("p_partkey", "name", "v")


def _stream(spark, sf_dir):
    return twins.source(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


def stream_dedup_append(spark, sf_dir):
    s = _stream(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return twins.drained(twins.first_seen(s, ["id"], "ts", "60 days"), "dedup").select("id")


def stream_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.groupBy().agg(F.max("ts").alias("t")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("t") + F.expr("interval 400 days")).alias("ts"))
    folder = scratch(spark, "session-input")
    rows.write.parquet(f"{folder}/a")
    end.coalesce(1).write.parquet(f"{folder}/b")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).parquet(folder)
    out = twins.drained(twins.sessions(stream, ["user_id"], "ts", "6 hours", "1 hour"), "sessions")
    return out.filter("user_id >= 0").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def batch_sessions(spark, sf_dir):
    s = trends.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, ["event_id"])
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).select("user_id", "start", "stop", "n")


def stream_late_join(spark, sf_dir):
    folder = scratch(spark, "late-input")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    far = F.expr("timestamp'2030-01-01'")
    reg = e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    reg.write.parquet(f"{folder}/r/a")
    spark.range(1).select(F.lit(-1).cast("long").alias("id"), far.alias("at")).write.parquet(f"{folder}/r/b")
    res = e.filter("event_type = 'click' AND event_id % 3 = 0").select(F.col("event_id").alias("id"), (F.col("ts") + F.expr("make_dt_interval(cast(event_id % 60 as int))")).alias("done"))
    res.write.parquet(f"{folder}/s/a")
    spark.range(1).select(F.lit(-2).cast("long").alias("id"), far.alias("done")).write.parquet(f"{folder}/s/b")
    read = lambda part, schema: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/{part}")
    out = twins.late_results(read("r", reg.schema), read("s", res.schema), "id", "at", "done", "30 days")
    return twins.drained(out, "late").filter("id >= 0").select("id", "is_pending")


def paged_stream(spark, sf_dir):
    """Lists of events by type, newest first: a stream reads the older half, ends, and goes on when the newer half is there."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    paged.register(spark)
    folder, path = scratch(spark, "pages"), scratch(spark, "paged-stream")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    kinds = ",".join(sorted(r[0] for r in e.select("event_type").distinct().collect()))  # a list for each is what the stream is told to read
    stream = lambda: spark.readStream.format("paged_json").option("template", folder + "/{key}-{page}.json").option("keys", kinds).option("id", "event_id").load()
    for rows in (e.filter(F.col("event_id") <= half), e):
        paged.write_pages(rows, "event_type", "event_id", folder, 200)
        out = twins.drained(stream(), "paged", path=path)
    got = out.select("key", F.from_json("row", "event_id long, user_id long").alias("r"))
    return got.select("r.event_id", F.col("key").alias("event_type"), "r.user_id")


def scans_due(spark, sf_dir):
    """Users are candidates at each event; their version changes now and then, and a scan counts for a day and a half."""
    folder = scratch(spark, "candidates")
    days = polls(spark, sf_dir).agg(F.min("day").alias("a"), F.max("day").alias("z")).first()
    step = max(1, ((days["z"] - days["a"]).days + 4) // 4)
    whole = polls(spark, sf_dir).select("user_id", F.floor(F.col("k") / 40).cast("string").alias("version"), "ts", F.floor(F.date_diff("day", F.lit(days["a"])) / step).alias("part"))
    path = scratch(spark, "scans")
    for k in range(4):  # each run goes on from the state of the one before
        whole.filter(F.col("part") == k).select("user_id", "version", "ts").write.mode("append").parquet(folder)
        with scans.rocks(spark):
            out = twins.drained(scans.due(twins.source(spark, folder, "*.parquet", "user_id long, version string, ts timestamp", per_batch=1_000_000), "user_id", "version", "ts", 1.5), "scans", path=path)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        unpivot_wide, numbered_unpivot, pseudo_attributes, subtotal_policy, filled_down, chunk_split, upsert_preserving, overwrite_guard, incremental_merge,
        file_catalog, wiki_cells, xml_rows, stream_dedup_append, stream_sessions, batch_sessions, stream_late_join,
        paged_stream, scans_due,
    )
}

SESSIONS_SQL = """with f as (select *, case when coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 21600000000, true) then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from f)
select user_id, min(ts) as start, max(ts) as stop, count(*) as n from s group by user_id, session"""

ORACLE_SQL = {
    "paged_stream": "select event_id, event_type, user_id from events",
    "scans_due": f"""with recursive {POLLS_SQL}, e as materialized (select user_id, ts, cast(k // 40 as varchar) as version, row_number() over (partition by user_id order by ts, k // 40) as n from polls),
r(user_id, n, version, at_, scan) as (select user_id, n, version, ts, true from e where n = 1
  union all select e.user_id, e.n, case when e.version <> r.version or e.ts > r.at_ + interval 36 hours then e.version else r.version end,
    case when e.version <> r.version or e.ts > r.at_ + interval 36 hours then e.ts else r.at_ end, e.version <> r.version or e.ts > r.at_ + interval 36 hours from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select user_id, version, at_ as "at" from r where scan""",
    "unpivot_wide": f"with {POLLS_SQL} select day, agency, party as option, cast(sum(k) as double) as votes from polls group by all having sum(k) is not null",
    "numbered_unpivot": "select l_orderkey, cast(l_linenumber as bigint) as pos, max(l_suppkey) as option, max(l_quantity) as votes from lineitem where l_linenumber <= 7 group by 1, 2",
    "pseudo_attributes": f"""with {POLLS_SQL} select day, agency, cast(sum(k) filter (party = 'signup') as bigint) as electors, cast(sum(k) filter (party = 'view') as bigint) as voters,
  cast(sum(k) filter (party not in ('signup', 'view')) as bigint) as votes, nullif(count(*) filter (party not in ('signup', 'view')), 0) as options from polls group by 1, 2""",
    "subtotal_policy": """select l_linestatus, sum(l_quantity) as l_quantity, 'parts' as which from lineitem where l_returnflag <> 'R' group by 1 union all
select l_linestatus, sum(l_quantity), 'totals' from lineitem where l_returnflag = 'R' group by 1""",
    "filled_down": """select event_id, last_value(case when event_type = 'click' then cast(event_id as varchar) end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as head from events""",
    "chunk_split": "select 'drill' as chunk, l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q from lineitem where l_linestatus = 'O' and l_returnflag <> 'A' group by 2, 3",
    "upsert_preserving": """select c_custkey, case when c_custkey % 2 = 0 and c_custkey % 4 <> 0 then c_mktsegment when c_custkey % 3 = 0 then lower(c_mktsegment) else '' end as c_mktsegment,
  case when c_custkey % 3 = 0 then 0 else c_acctbal end as c_acctbal from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0""",
    "overwrite_guard": """select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus = 'P' union all
select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus <> 'P' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""",
    "incremental_merge": "select event_id, user_id, case when event_type < 'p' then event_type else upper(event_type) end as event_type from events",
    "wiki_cells": """with l as (select doc_id, unnest(string_split(regexp_replace(text, '[^A-Za-zÀ-ÿ,. ]', '', 'g'), '. ')) as line from documents)
select doc_id, array_to_string(list_transform(string_split(line, ', '), lambda c: trim(c)), '/') as cells from l""",
    "xml_rows": "select p_partkey, unnest(string_split(p_name, ' ')) as name, cast(p_size as bigint) as v from part where p_size % 10 <> 0",
    "file_catalog": "select case when o_orderpriority < '3' then 'high' when o_orderpriority < '4' then 'medium' else 'other' end as kind, count(distinct o_orderpriority) as files from orders group by 1",
    "stream_dedup_append": "select distinct user_id as id from events",
    "stream_sessions": SESSIONS_SQL,
    "batch_sessions": SESSIONS_SQL,
    "stream_late_join": "select event_id as id, not (event_id % 3 = 0 and event_id % 60 <= 30) as is_pending from events where event_type = 'click'",
}

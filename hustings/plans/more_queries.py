"""Queries of readers, sinks, plain filters and joins, sorts, and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.functions import text
from hustings.operators import audit, dedup, extraction, filters, joins, ranking, rollups, tables
from hustings.operators.tables import Words
from hustings.plans.tables import PLACED_SQL, POLLS_SQL, placed, polls, table
from hustings.sources import readers, sinks
from hustings.streaming import twins
from hustings.workers import scratch

# Readers and sinks work on files that the query itself has written into the shared folder.


def csv_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch(spark, "csv-by-key")
    o.write.option("header", True).csv(f"{path}/a")
    o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus")).write.option("header", True).csv(f"{path}/b")
    return readers.csv_by_key(spark, f"{path}/*", "o_orderkey long, o_orderstatus string", "o_orderkey")


def csv_first_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = scratch(spark, "first-of")
    o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus")).write.option("header", True).csv(f"{path}/a")
    o.write.option("header", True).csv(f"{path}/b")
    return readers.first_of(spark, [f"{path}/a", f"{path}/b"], "o_orderkey long, o_orderstatus string", "o_orderkey")


def json_folder(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("members"))
    path = scratch(spark, "json-folder")
    doc = F.when(F.col("c_nationkey") == 3, "{broken").otherwise(F.to_json(F.struct("c_nationkey", "members")))
    c.select("c_nationkey", doc.alias("value")).withColumn("k", F.col("c_nationkey")).drop("c_nationkey").write.partitionBy("k").text(path)
    fine, broken = readers.json_documents(spark, path, "c_nationkey long, members array<struct<c_custkey:long,c_acctbal:double>>")
    good = fine.select("c_nationkey", F.size("members").cast("long").alias("n"), F.round(F.aggregate("members", F.lit(0.0), lambda a, m: a + m["c_acctbal"]), 2).alias("total"))
    return good.unionByName(broken.select(F.regexp_extract("file", "k=([0-9]+)", 1).cast("long").alias("c_nationkey"), F.lit(-1).cast("long").alias("n"), F.lit(None).cast("double").alias("total")))


def tsv_numbers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key no"), F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.format_number(F.col("s_suppkey") * 1234, 0)).alias("votes cast"))
    path = scratch(spark, "tsv")
    s.write.option("header", True).option("sep", "\t").csv(path)
    return readers.tsv(spark, path, {"key": "key no", "votes": "votes cast"}, ["votes"]).select(F.col("key").cast("long").alias("key"), "votes")


def encoded_csv(spark, sf_dir):
    """Documents in one folder, languages in files of their own, in several character sets."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.trim(F.regexp_replace("text", r"[^ !#-\[\]-~À-ÿ]", "")), F.lit("")).alias("t"), "lang")
    path = scratch(spark, "sets")
    for lang, kind in (("fr", "ISO-8859-1"), ("de", "ISO-8859-1"), ("es", "UTF-16")):
        d.filter(F.col("lang") == lang).drop("lang").write.mode("append").option("header", True).option("encoding", kind).csv(path)
    d.filter(~F.coalesce(F.col("lang").isin("fr", "de", "es"), F.lit(False))).drop("lang").write.mode("append").option("header", True).csv(path)
    return readers.encoded_csv(spark, path, "doc_id long, t string")


def sparql_solutions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return readers.solutions(o.unpivot(["node"], ["status", "priority"], "variable", "value"), "node", "variable", "value", ["status", "priority"])


def sparql_races(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").cast("string").alias("race"), F.col("o_orderkey").cast("string").alias("candidate"), F.col("o_totalprice").cast("string").alias("votes"))
    s = readers.solutions(o.unpivot(["node"], ["race", "candidate", "votes"], "variable", "value"), "node", "variable", "value", ["race", "candidate", "votes"])
    s = s.select(F.col("race").cast("long").alias("race"), F.col("candidate").cast("long").alias("candidate"), F.col("votes").cast("double").alias("votes"))
    r = ranking.rank_options(s, ["race"], "votes", ["candidate"])
    return r.select("race", "candidate", F.col("rank").cast("long").alias("rank"), "won")


def present_union(spark, sf_dir):
    path = scratch(spark, "present")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.json(f"{path}/there")
    return readers.present(spark, [f"{path}/there", f"{path}/missing"], "r_regionkey long, r_name string")


def chunks_all(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    path = scratch(spark, "all-chunks")
    sinks.split(li, path, sinks.chunk(F.col("l_returnflag"), F.col("l_linestatus"), {"F": ["A", "N"]}))
    return readers.chunks(spark, path, f"{', '.join(f'{n} {t}' for n, t in li.dtypes)}, chunk string").groupBy("chunk", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def stats_sink(spark, sf_dir):
    path = scratch(spark, "with-stats")
    li = table(spark, sf_dir, "lineitem")
    sinks.with_stats(li.select("l_orderkey", "l_quantity"), path, [F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_orderkey").alias("last")])
    rows = spark.read.schema("l_orderkey long, l_quantity double").json(f"{path}/rows").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_orderkey").alias("last"))
    return spark.read.schema("n long, q double, last long").json(f"{path}/meta").withColumn("of", F.lit("meta")).unionByName(rows.withColumn("of", F.lit("rows")))


def lite_projection(spark, sf_dir):
    path = scratch(spark, "lite")
    sinks.lite(polls(spark, sf_dir), path, F.col("party").isin("click", "view") & (F.col("pct") > 10), ["event_id", "party"])
    return spark.read.schema("event_id long, party string").parquet(path)


def csv_append(spark, sf_dir):
    path = scratch(spark, "append")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        sinks.append_csv(o.filter(F.col("o_orderstatus") == status), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").option("header", True).csv(path)


def stream_merge_twice(spark, sf_dir):
    path = scratch(spark, "merged")
    for again in ("first", "second"):  # a second run over the same files adds nothing
        twins.merged(twins.source(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema).select("user_id", "event_type"), path, ["user_id", "event_type"], f"twice-{again}")
    return spark.read.schema("user_id long, event_type string").parquet(path)


def match_gate(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    rate = audit.match_rate(j, F.col("c_mktsegment").isNotNull(), 0.97)  # raises below it: nothing would be written
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("rate", F.lit(round(rate, 6)))


def rounded_coordinates(spark, sf_dir):
    e = polls(spark, sf_dir).select("event_id", sinks.rounded(F.array(F.array(F.col("pct") / 3, F.col("pct") / 7)), 4).alias("c"))
    return e.select("event_id", F.col("c")[0][0].alias("x"), F.col("c")[0][1].alias("y"))


def negative_cache(spark, sf_dir):
    c = polls(spark, sf_dir).select("event_id", F.col("agency").alias("version"))
    scanned = polls(spark, sf_dir).filter("party <> 'view'").select("event_id", F.when(F.col("party") == "click", F.col("agency") + 1).otherwise(F.col("agency")).alias("version"))
    return sinks.to_scan(c, scanned, ["event_id"], "version")


def round_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), text_suffix(F.col("n_nationkey")), F.lit("-"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")), F.lit("-2026")).alias("id"))
    return n.select(F.col("n_nationkey").cast("long").alias("k"), text.round_label(F.col("id"), {"france": "FR", "japan": "JP"}).alias("label"))


def text_suffix(n):
    return ranking.ordinal_suffix(n)


def ordinals(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), ranking.ordinal_suffix(F.col("p_size"))).alias("nth"))


def stem_join(spark, sf_dir):
    word = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    words = word.select(F.explode(F.array("w", F.concat("w", F.lit("er")), F.concat("w", F.lit("ing")))).alias("w")).distinct().withColumn("stem", text.stem(F.col("w"), ["ing", "er", "e", "n"]))
    other = words.select(F.col("w").alias("other"), "stem")
    return words.join(other, "stem").filter("w < other").select("stem", "w", "other")


def paired_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.least("l_linenumber", F.lit(2)).alias("at")).agg(F.min("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"))
    return readers.paired_rows(li, ["l_orderkey"], "at", ["a", "b"], ("name", "party")).select("l_orderkey", F.col("pos").cast("long").alias("pos"), "name", "party")


def scope_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


def partial_sample_drop(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("unit", F.when(F.col("k") % 4 != 0, F.col("user_id").cast("string")))
    return p.filter(~((F.col("party") == "click") & (F.coalesce("unit", F.lit("")) != ""))).select("event_id")


def campaign_start(spark, sf_dir):
    return polls(spark, sf_dir).filter(F.col("day") >= F.lit("2024-01-12").cast("date")).select("event_id", "day")


def own_polls(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(filters.any_rule(F.col("text"), ["tion", "[0-9]{3}"]) & ~filters.any_rule(F.col("text"), ["^The", "password"])).select("doc_id")


def roster_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def half_open_terms(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    terms = spark.createDataFrame([("1990-01-01", "1996-07-01", "first"), ("1996-07-01", "1998-01-01", "second"), ("1998-01-01", None, "third")], "start string, stop string, colour string")
    terms = terms.select(F.to_date("start").alias("start"), F.to_date("stop").alias("stop"), "colour")
    return joins.within_term(orders, terms, "day", "start", "stop", ["colour"], half_open=True).select("o_orderkey", "colour")


def person_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("person"))
    return c.join(s, "c_nationkey", "left").select("c_custkey", "person")


def parent_broadcast(spark, sf_dir):
    parent = table(spark, sf_dir, "part").groupBy(F.substring("p_brand", 1, 7).alias("parent")).agg(F.max("p_size").alias("stored"))
    return table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("parent")).join(parent, "parent", "left").select("p_partkey", F.col("stored").cast("long").alias("stored"))


def merged_units(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("unit", text.stem(F.substring_index("n_name", " ", 1), ["IA", "A", "N"]))
    return rollups.recomputed_share(p, ["unit"], ["l_returnflag"], "l_quantity", 6)


def code_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.substring(F.lpad(F.col("l_partkey").cast("string"), 8, "0"), 1, 6).alias("code")).agg(F.sum("l_quantity").alias("votes"), F.count("*").alias("n"))


def party_appearances(spark, sf_dir):
    p = placed(spark, sf_dir)
    shape = lambda kind, key, value: p.groupBy("n_name", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("round")).agg(value.cast("long").alias("metric"))
    every = shape("flag", "l_returnflag", F.count("*")).unionByName(shape("line", "l_linenumber", F.sum("l_quantity"))).unionByName(shape("status", "l_linestatus", F.max("l_quantity")))
    seen = every.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("kind", "round", "metric"))).alias("a"))
    return seen.select("n_name", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["kind"], x["round"], x["metric"].cast("string"))), ",").alias("appearances"))


def office_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("won"))


def counting_completeness(spark, sf_dir):
    s = twins.source(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema).select((F.col("user_id") % 50).alias("unit"), F.least(F.lit(100.0), F.col("value") + 97).alias("pct"))
    return twins.completeness(s, ["unit"], "pct", "counting", least=97.2, mean=99.5).select("unit", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), "is_final")


def manifest_summary(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("kind"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return readers.catalogue_summary(files)


def multi_key_sort(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("races"), F.count_if(F.col("o_orderstatus") == "F").alias("wins"))
    return c.orderBy(F.col("races").desc(), F.col("wins").desc(), "o_custkey").limit(50)


def custom_order(spark, sf_dir):
    order = spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 1), ("AUTOMOBILE", 2)], "c_mktsegment string, at int")
    c = table(spark, sf_dir, "customer").join(order, "c_mktsegment", "left").withColumn("at", F.coalesce("at", F.lit(99)))
    return c.orderBy("at", F.col("c_acctbal").desc(), "c_custkey").limit(200).select("c_custkey", F.col("at").cast("long").alias("place"))


def newest_then_drop(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).drop("o_orderdate").select("o_orderkey", "o_custkey")


def mixed_union(spark, sf_dir):
    e = polls(spark, sf_dir).select("day", F.col("party").alias("title"), F.lit(0).cast("long").alias("kind"), "event_id")
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.lit(1).cast("long").alias("kind"), "o_orderkey")
    return e.unionByName(o, allowMissingColumns=True).select("day", "title", "kind", "event_id", "o_orderkey")


def replaced_part(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.replaced(o, o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey"), F.lit("Q").alias("o_orderstatus")), F.col("o_orderstatus") == "P")


def party_support(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("pct", F.round(F.col("pct") / 2))
    return dedup.party_support(p, ["user_id", "day"], "party", "pct", ["click", "view"])


def office_reclassified(spark, sf_dir):
    p = polls(spark, sf_dir).select("event_id", (F.col("user_id") % 200).alias("unit"), F.col("party").alias("office"), "k")
    return dedup.reclassified(p, ["unit"], "office", ["event_id"], F.col("k") % 9 == 0).select("event_id", "office")


def gate_with_parties(spark, sf_dir):
    p = polls(spark, sf_dir).withColumn("name", F.when(F.col("k") % 9 == 0, "").otherwise(F.substring(F.sha2(F.col("pct").cast("string"), 256), 1, 3)))
    p = p.withColumn("name", F.regexp_replace("name", "[0-9]", "q")).withColumn("side", F.when(F.col("user_id") % 3 != 0, F.col("party")).otherwise(""))
    known = dedup.supported(p.filter("name <> ''"), ["name"], "agency", 15)
    return dedup.known_candidates(p, ["user_id", "day"], "name", known, party="side").select("event_id")


def district_parts(spark, sf_dir):
    """Parts' names as compound districts; the type is a marker at the end of some, in the file's name of others."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("·")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""))
    d = text.district_parts(name, F.concat(F.lit("list-"), F.reverse("p_type"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("")), ["ECONOMY", "PROMO", "SMALL"], ["ing", "ot", "d", "e"])
    return p.select("p_partkey", F.array_join(d["parts"], "/").alias("parts"), d["marker"].alias("marker"))


def _grid(spark, sf_dir):
    """Tables of four parts, a row each, of cells that are words, numbers, shares or empty."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    cells = [
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.get(words, F.lit(0))),
        F.when(F.col("p_size") % 3 == 0, F.concat((F.col("p_size") * 100).cast("string"), F.lit(",5"))).otherwise(F.get(words, F.lit(1))),
        F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 < 3, F.concat(F.lit("("), (F.col("p_size") % 7).cast("string"), F.lit("%)"))).otherwise(F.get(words, F.lit(1))),
    ]
    return p.select(F.floor(F.col("p_partkey") / 4).alias("tab"), (F.col("p_partkey") % 4).alias("row"), F.array(*cells).alias("cells"))


def table_headers(spark, sf_dir):
    h = extraction.header(_grid(spark, sf_dir), ["tab"], "row", "cells")
    return h.select("tab", F.inline("header")).select("tab", F.col("column").cast("long").alias("place"), "text")


def data_rows(spark, sf_dir):
    return _grid(spark, sf_dir).select("tab", "row", extraction.data_row(F.col("cells")).alias("is_data"))


WORDS = Words(
    parties=("red", "blue", "ring", "redring"), name="[a-z]{3,5}", total="^(large|total)$", metric=("PROMO",), party_title="ECO", offices=("gear", "plate"),
    no_names=("hot", "old"), no_columns=("cold",), answers=("bolt", "rod"),
)


def table_options(spark, sf_dir):
    """Six parts a table: words of their names, sizes and shares are cells; the first part's type is the title."""
    p = table(spark, sf_dir, "part")
    one, two = F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))
    row, size = F.col("p_partkey") % 6, F.col("p_size")
    late = row >= 3
    cells = F.array(
        F.when(late & (size % 2 == 0), size.cast("string")).otherwise(one),
        F.when(late, F.concat((size % 101).cast("string"), F.lit("%"))).when(size % 3 == 0, "").otherwise(F.concat(two, one)),
        F.when(late, F.concat(size.cast("string"), F.lit(".5"))).when(size % 4 == 0, "").otherwise(F.concat(one, two)),
        F.when(late, (size * 3).cast("string")).when(size % 5 < 3, "").otherwise(two),
    )
    rows = p.select(F.floor(F.col("p_partkey") / 6).alias("tab"), row.alias("row"), cells.alias("cells"), "p_type")
    titles = rows.groupBy("tab").agg(F.min_by("p_type", "row").alias("title"))
    found = tables.headed(tables.whole(rows, ["tab"], "row", "cells"), WORDS).join(titles, "tab")
    return tables.options(found, ["tab"], WORDS, "title").withColumn("place", F.col("place").cast("long"))


def title_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", extraction.first_match(F.col("text"), [r"([0-9]{4})", r"(?:^|\s)(th[a-z]+)"], F.lit("none")).alias("title"))


def _page_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return d.withColumn("line", F.col("line").cast("long"))


def total_lines(spark, sf_dir):
    return extraction.total_line(_page_lines(spark, sf_dir), ["doc_id"], "line", "t", " la ", "The", 1).select("doc_id", "line")


def column_values(spark, sf_dir):
    """The numbers of each line, and of parts' sizes that make up a whole or not."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(-1).cast("long").alias("line"), F.concat_ws(" ", "p_size", F.lit("(n=77)"), (F.col("p_size") * 2.5).cast("string"), (F.col("p_size") % 3 + 99).cast("string")).alias("t"))
    both = _page_lines(spark, sf_dir).withColumnRenamed("doc_id", "p_partkey").unionByName(p)
    v = both.select(F.col("p_partkey").alias("page"), "line", extraction.column_values(F.col("t")).alias("v"))
    return v.select("page", "line", F.size("v").cast("long").alias("n"), F.array_max("v").alias("most"), F.element_at("v", -1).alias("last")).filter("n > 0")


def paired_header(spark, sf_dir):
    """Six parts a page, their names as lines; some lines are data."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 6).alias("page"), (F.col("p_partkey") % 6).alias("line"), F.concat(F.when(F.col("p_size") % 17 == 0, "=").otherwise(""), "p_name").alias("t"))
    out = extraction.paired_header(p, ["page"], "line", "t", ["red", "ol", "hot", "blue", "bolt", "ring", "widget"], name="[a-z]{2,5}", words=["new", "small"], data="^=", body="=")
    return out.select("page", F.col("pos").cast("long").alias("pos"), "party", "name")


def leak_repair(spark, sf_dir):
    n = F.when(F.col("s_suppkey") % 3 == 0, "giKimab").when(F.col("s_suppkey") % 3 == 1, "giKimabcd").otherwise("Leexy")
    return table(spark, sf_dir, "supplier").select("s_suppkey", extraction.without_leak(n, "gi", ["Kim", "Lee"]).alias("name"))


def preferred_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    other = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'").select("l_orderkey", F.col("l_suppkey").alias("l_partkey"), "l_quantity")
    return extraction.preferred_rows(li, other, ["l_orderkey"], F.col("l_quantity") > 5, "l_partkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def question_overlay(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    new = q.filter("l_linenumber = 2").select("l_orderkey", "l_linenumber", F.lit(9).cast("long").alias("n"), F.lit("new").alias("flag"))
    return extraction.overlaid(q, new, ["l_orderkey"], "l_linenumber", F.col("flag") == "R").select("l_orderkey", F.col("l_linenumber").cast("long").alias("question"), "n", "flag")


def glyph_repair(spark, sf_dir):
    """Parts' names of which some have letters turned into syllables."""
    t = F.when(F.col("p_size") % 2 == 0, F.translate("p_name", "sr", "가나")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", extraction.repaired_glyphs(t, {"o": "오", "e": "에", "l": "x", "gi": "기"}, ["widget", "old"]).alias("t"))


def best_files(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", F.when(F.col("l_linenumber") == 1, "form").when(F.col("l_linenumber") % 3 == 0, "stats").when(F.col("l_linenumber") % 3 == 1, "result").otherwise("annex"), F.col("l_suppkey").cast("string")).alias("name"))
    return readers.best_file(f, "l_orderkey", "name", ["result", "stats"], "form")


QUERIES = {
    f.__name__: f
    for f in (
        csv_last_wins, csv_first_wins, json_folder, tsv_numbers, encoded_csv, sparql_solutions, sparql_races, present_union, chunks_all, stats_sink, lite_projection, csv_append,
        stream_merge_twice, match_gate, rounded_coordinates, negative_cache, round_labels, ordinals, stem_join, paired_rows, scope_filter, partial_sample_drop, campaign_start, own_polls,
        roster_semi, half_open_terms, person_rows, parent_broadcast, merged_units, code_sums, party_appearances, office_summary, counting_completeness, manifest_summary, multi_key_sort,
        custom_order, newest_then_drop, mixed_union, replaced_part, party_support, office_reclassified, gate_with_parties, district_parts, table_headers, data_rows, table_options, title_cascade,
        total_lines, column_values, paired_header, leak_repair, preferred_rows, question_overlay, glyph_repair, best_files,
    )
}

WITH_SUFFIX = "case when n % 100 between 11 and 13 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end"
STEM_SQL = "case when w like '%ing' and length(w) > 3 then left(w, length(w) - 3) when w like '%er' and length(w) > 2 then left(w, length(w) - 2) when w like '%e' and length(w) > 1 then left(w, length(w) - 1) when w like '%n' and length(w) > 1 then left(w, length(w) - 1) else w end"
LINES_SQL = r"l as (select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as line, unnest(string_split(text, chr(10))) as t from documents)"
GRID_SQL = """with w as (select p_partkey // 4 as tab, p_partkey % 4 as row, p_size, string_split(p_name, ' ') as w from part),
c as (select tab, row, [case when p_size % 2 = 0 then cast(p_size as varchar) else w[1] end, case when p_size % 3 = 0 then (p_size * 100) || ',5' else w[2] end,
  case when p_size % 5 = 0 then '' when p_size % 7 < 3 then '(' || (p_size % 7) || '%)' else w[2] end] as cells from w),
d as (select *, list_filter(cells, lambda x: x <> '') as filled from c),
g as (select *, len(list_filter(filled, lambda x: regexp_matches(x, '^[(]?[0-9]+([.,][0-9]+)?%?[)]?$'))) >= 0.6 * len(filled) as is_data from d)"""

ORACLE_SQL = {
    "csv_last_wins": "select o_orderkey, case when o_orderstatus = 'F' then 'X' else o_orderstatus end as o_orderstatus from orders",
    "csv_first_wins": "select o_orderkey, case when o_orderstatus = 'F' then 'X' else o_orderstatus end as o_orderstatus from orders",
    "json_folder": "select cast(c_nationkey as bigint) as c_nationkey, case when c_nationkey = 3 then -1 else count(*) end as n, case when c_nationkey <> 3 then round(sum(c_acctbal), 2) end as total from customer group by c_nationkey",
    "tsv_numbers": "select cast(s_suppkey as bigint) as key, case when s_suppkey % 7 <> 0 then cast(s_suppkey * 1234 as double) end as votes from supplier",
    "encoded_csv": r"select doc_id, nullif(trim(regexp_replace(text, '[^ !#-\[\]-~À-ÿ]', '', 'g')), '') as t from documents",
    "sparql_solutions": "select o_orderkey as node, o_orderstatus as status, o_orderpriority as priority from orders",
    "sparql_races": "select o_custkey as race, o_orderkey as candidate, row_number() over w as rank, row_number() over w = 1 as won from orders window w as (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey)",
    "present_union": "select cast(r_regionkey as bigint) as r_regionkey, r_name from region",
    "chunks_all": "select case when l_linestatus = 'F' and l_returnflag not in ('A', 'N') then 'drill' else 'core' end as chunk, l_linestatus, count(*) as n, sum(l_quantity) as q from lineitem group by 1, 2",
    "stats_sink": "select count(*) as n, sum(l_quantity) as q, max(l_orderkey) as last, k as of from lineitem, (values ('meta'), ('rows')) v(k) group by k",
    "lite_projection": f"with {POLLS_SQL} select event_id, party from polls where party in ('click', 'view') and pct > 10",
    "csv_append": "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O', 'P')",
    "stream_merge_twice": "select distinct user_id, event_type from events",
    "match_gate": """with j as (select * from orders left join customer on c_custkey = o_custkey)
select c_mktsegment, count(*) as n, (select round(avg(cast(c_mktsegment is not null as int)), 6) from j) as rate from j group by 1""",
    "rounded_coordinates": f"with {POLLS_SQL} select event_id, round(pct / 3, 4) as x, round(pct / 7, 4) as y from polls",
    "negative_cache": f"with {POLLS_SQL} select event_id, agency as version from polls where party in ('view', 'click')",
    "round_labels": f"""with i as (select n_nationkey as n, lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) as kind from nation)
select cast(n as bigint) as k, n || ' ' || case kind when 'france' then 'FR' when 'japan' then 'JP' else kind end as label from i""",
    "ordinals": f"select p_partkey, n || {WITH_SUFFIX} as nth from (select p_partkey, p_size as n from part)",
    "stem_join": f"""with p as (select distinct unnest(string_split(p_name, ' ')) as w from part), w as (select distinct w || e as w from p, (values (''), ('er'), ('ing')) v(e)), s as (select w, {STEM_SQL} as stem from w)
select a.stem, a.w, b.w as other from s a join s b on a.stem = b.stem and a.w < b.w""",
    "paired_rows": """with g as (select l_orderkey, least(l_linenumber, 2) as place, min(l_returnflag) as a, max(l_linestatus) as b from lineitem group by 1, 2),
k as (select *, row_number() over (partition by l_orderkey order by place) as k from g),
c as (select l_orderkey, k, cast(0 as bigint) as pos, a as v from k union all select l_orderkey, k, 1, b from k)
select l_orderkey, pos, max(v) filter (k = 1) as name, max(v) filter (k = 2) as party from c group by 1, 2 having count(*) filter (k = 2) > 0""",
    "scope_filter": "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')",
    "partial_sample_drop": f"with {POLLS_SQL} select event_id from polls where party <> 'click' or k % 4 = 0 or k is null",
    "campaign_start": f"with {POLLS_SQL} select event_id, day from polls where day >= date '2024-01-12'",
    "own_polls": "select doc_id from documents where regexp_matches(text, 'tion|[0-9]{3}') and not regexp_matches(text, '^The|password')",
    "roster_semi": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "half_open_terms": """select o_orderkey, case when d >= date '1990-01-01' and d < date '1996-07-01' then 'first' when d >= date '1996-07-01' and d < date '1998-01-01' then 'second' when d >= date '1998-01-01' then 'third' end as colour
from (select o_orderkey, cast(o_orderdate as date) as d from orders)""",
    "person_rows": "select c_custkey, person from customer left join (select s_nationkey, min(s_suppkey) as person from supplier group by 1) on s_nationkey = c_nationkey",
    "parent_broadcast": "select p_partkey, cast(max(p_size) over (partition by substr(p_brand, 1, 7)) as bigint) as stored from part",
    "merged_units": f"""with {PLACED_SQL}, u as (select split_part(n_name, ' ', 1) as w, l_returnflag, l_quantity from placed),
s as (select case when w like '%IA' and length(w) > 2 then left(w, length(w) - 2) when w like '%A' and length(w) > 1 then left(w, length(w) - 1) when w like '%N' and length(w) > 1 then left(w, length(w) - 1) else w end as unit, l_returnflag, sum(l_quantity) as votes from u group by 1, 2)
select unit, l_returnflag, votes, round(votes / sum(votes) over (partition by unit) * 100, 6) as share from s""",
    "code_sums": "select substr(lpad(cast(l_partkey as varchar), 8, '0'), 1, 6) as code, sum(l_quantity) as votes, count(*) as n from lineitem group by 1",
    "party_appearances": f"""with {PLACED_SQL}, s as (select n_name, 'flag' as kind, l_returnflag as r, count(*) as m from placed group by all union all
  select n_name, 'line', cast(l_linenumber as varchar), cast(sum(l_quantity) as bigint) from placed group by all union all select n_name, 'status', l_linestatus, cast(max(l_quantity) as bigint) from placed group by all)
select n_name, string_agg(kind || ':' || r || ':' || m, ',' order by kind, r) as appearances from s group by 1""",
    "office_summary": "select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as won from orders where o_orderstatus <> 'P' group by 1",
    "counting_completeness": """with s as (select user_id % 50 as unit, least(100.0, value + 97) as pct from events), g as (select unit, min(pct) as l, avg(pct) as m from s group by 1)
select unit, round(l, 6) as least, round(m, 6) as mean, l >= 97.2 and m >= 99.5 as is_final from g""",
    "manifest_summary": "select coalesce(lang, 'none') as kind, count(*) as files, cast(sum(coalesce(strlen(text), 0)) as bigint) as bytes from documents group by 1",
    "multi_key_sort": "select o_custkey, count(*) as races, count(*) filter (o_orderstatus = 'F') as wins from orders group by 1 order by 2 desc, 3 desc, 1 limit 50",
    "custom_order": "select c_custkey, cast(case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 when 'AUTOMOBILE' then 2 else 99 end as bigint) as place from customer order by place, c_acctbal desc, c_custkey limit 200",
    "newest_then_drop": "select o_orderkey, o_custkey from (select * from orders order by o_orderdate desc, o_orderkey limit 100)",
    "mixed_union": f"with {POLLS_SQL} select day, party as title, cast(0 as bigint) as kind, event_id, null as o_orderkey from polls union all select cast(o_orderdate as date), null, 1, null, o_orderkey from orders",
    "replaced_part": "select o_orderkey, case when o_orderstatus = 'P' then 'Q' else o_orderstatus end as o_orderstatus from orders",
    "party_support": f"""with {POLLS_SQL}, g as (select user_id, day, party, max(round(pct / 2)) as pct from polls group by all)
select user_id, day, party, pct from g window w as (partition by user_id, day) qualify sum(pct) over w between 20 and 102 and max(pct) over w <= 65 and count(*) filter (party in ('click', 'view')) over w = 2""",
    "office_reclassified": f"""with {POLLS_SQL}, p as (select event_id, user_id % 200 as unit, party as office, k from polls), g as (select unit, office, count(*) as n, min(event_id) as f from p where k % 9 = 0 group by 1, 2),
t as (select *, sum(n) over (partition by unit) as total, row_number() over (partition by unit order by n desc, f) as r from g), v as (select unit, office from t where r = 1 and (n = total or n >= 2 * (total - n)))
select event_id, coalesce(v.office, p.office) as office from p left join v on p.unit = v.unit""",
    "district_parts": """with p as (select p_partkey, p_size, p_type, unnest(generate_series(1, len(string_split(p_name, ' ')))) as i, unnest(string_split(p_name, ' ')) as w from part),
s as (select *, case when w like '%ing' and length(w) > 3 then left(w, length(w) - 3) when w like '%ot' and length(w) > 2 then left(w, length(w) - 2) when w like '%d' and length(w) > 1 then left(w, length(w) - 1)
  when w like '%e' and length(w) > 1 then left(w, length(w) - 1) else w end as stem, p_type in ('ECONOMY', 'PROMO', 'SMALL') as known from p),
n as (select *, max(i) over (partition by p_partkey) as last from s)
select p_partkey, string_agg(case when i = last and p_size % 2 = 0 and not known then w || ' ' || p_type else stem end, '/' order by i) as parts,
  any_value(case when known and (p_size % 2 = 0 or p_size % 3 = 0) then p_type else '' end) as marker from n group by 1""",
    "table_headers": f"""{GRID_SQL}, a as (select *, max(cast(is_data as int)) over (partition by tab order by row) as seen from g),
x as (select tab, row, unnest([0, 1, 2]) as place, unnest(cells) as t from a where seen = 0), f as (select tab, place, t, min(row) as first from x where t <> '' group by 1, 2, 3)
select tab, cast(place as bigint) as place, string_agg(t, ' ' order by first) as text from f group by 1, 2""",
    "data_rows": f"{GRID_SQL} select tab, row, is_data from g",
    "table_options": r"""with w as (select p_partkey // 6 as tab, p_partkey % 6 as row, p_size as s, p_type, string_split(p_name, ' ') as w from part),
c as (select tab, row, p_type, [case when row >= 3 and s % 2 = 0 then cast(s as varchar) else w[1] end, case when row >= 3 then (s % 101) || '%' when s % 3 = 0 then '' else w[2] || w[1] end,
  case when row >= 3 then s || '.5' when s % 4 = 0 then '' else w[1] || w[2] end, case when row >= 3 then cast(s * 3 as varchar) when s % 5 < 3 then '' else w[2] end] as cells from w),
f as (select *, len(list_filter(cells, lambda x: x <> '')) as n, len(list_filter(cells, lambda x: regexp_matches(x, '^\(?[0-9]+([.,][0-9]+)?%?\)?$'))) as numbers,
  len(list_filter(cells, lambda x: x in ('large', 'total'))) > 0 as is_total, list_max(list_transform(cells, lambda x: length(x))) as longest from c),
d as (select *, n >= 3 and numbers >= greatest(2, floor(n * 0.6)) as is_data, n = 1 or (longest > 10 and n <= 2) as is_title from f),
t as (select tab, coalesce(min(row) filter (is_total), min(row) filter (is_data), 0) as start, arg_min(p_type, row) as title from d group by 1),
h as (select tab, title, start, place, string_agg(case when (start = 0 and row = 0) or (row < start and not is_title) then cells[place + 1] else '' end, '' order by row) as h
  from d join t using (tab), (values (0), (1), (2), (3)) v(place) group by all),
b as (select *, replace(replace(replace(replace(h, 'redring', ''), 'blue', ''), 'ring', ''), 'red', '') as bare, regexp_matches(h, 'red|blue|ring') as has from h),
n as (select *, case when length(bare) <= 6 then regexp_extract(bare, '^([a-z]{3,5})$', 1) when contains(bare, 'gear') or contains(bare, 'plate') then regexp_extract(bare, '^([a-z]{3,5})', 1) else '' end as named from b),
k as (select tab, case when any_value(title) = 'PROMO' then 'metric' when contains(any_value(title), 'ECO') and count(*) filter (has) >= 3 then 'party'
  when count(*) filter (named not in ('', 'hot', 'old')) > 0 then 'candidate' when count(*) filter (has) > 0 then 'party' else 'skip' end as kind from n group by 1),
x as (select d.tab, row, cells, is_total from d join t using (tab) where row >= greatest(start, 1)), r as (select tab, arg_min(cells, (not is_total, row)) as data from x group by 1),
o as (select tab, kind, place, h, case when contains(h, 'redring') then 'redring' when contains(h, 'blue') then 'blue' when contains(h, 'ring') then 'ring' when contains(h, 'red') then 'red' else '' end as party,
  nullif(regexp_extract(data[place + 1], '([0-9]{1,3}(?:\.[0-9]+)?)', 1), '') as share from b join k using (tab) join r using (tab) where kind in ('candidate', 'party') and h <> ''),
p as (select *, case when party = '' then 0 else strpos(h, party) end as spot from o where not contains(h, 'cold') and (party <> '' or not regexp_matches(h, 'bolt|rod'))),
q as (select *, list_filter(regexp_extract_all(case when party = '' then '' else left(h, spot - 1) end, '[a-z]{3,5}'), lambda z: z not in ('hot', 'old')) as before,
  list_filter(regexp_extract_all(case when party = '' then h else substr(h, spot + length(party)) end, '[a-z]{3,5}'), lambda z: z not in ('hot', 'old')) as after from p),
z as (select tab, kind, cast(place as bigint) as place, party, case when kind = 'party' then '' when len(before) > 0 then before[len(before)] else after[1] end as name, cast(share as double) as share from q)
select * from z where share between 0 and 100 and name is not null""",
    "title_cascade": r"select doc_id, coalesce(nullif(regexp_extract(text, '([0-9]{4})', 1), ''), nullif(regexp_extract(text, '(?:^|\s)(th[a-z]+)', 1), ''), 'none') as title from documents",
    "total_lines": f"""with {LINES_SQL}, k as (select *, case when contains(t, ' la ') then 0 when starts_with(ltrim(t), 'The') and regexp_matches(t, '[0-9]') then 1 end as kind from l)
select doc_id, line from k where kind is not null qualify row_number() over (partition by doc_id order by kind, line) = 1""",
    "column_values": rf"""with {LINES_SQL}, b as (select doc_id as page, line, t from l union all select p_partkey, -1, p_size || ' (n=77) ' || (p_size * 2.5) || ' ' || (p_size % 3 + 99) from part),
v as (select page, line, list_transform(regexp_extract_all(regexp_replace(t, '\([^)]*\)', ' ', 'g'), '[0-9]+(?:\.[0-9]+)?'), lambda x: cast(x as double)) as v from b),
u as (select page, line, case when len(v) > 0 and abs(v[len(v)] - 100) <= 0.5 then v[1 : len(v) - 1] else v end as v from v)
select page, line, len(v) as n, list_max(v) as most, v[len(v)] as last from u where len(v) > 0""",
    "paired_header": """with l as (select p_partkey // 6 as page, p_partkey % 6 as line, case when p_size % 17 = 0 then '=' else '' end || p_name as t from part),
w as (select page, line, string_agg(t, ' ') over (partition by page order by line rows between current row and 2 following) as near from l),
h as (select page, line, contains(near, '=') as data, list_filter(['widget', 'blue', 'bolt', 'ring', 'red', 'hot', 'ol'], lambda p: contains(near, p)) as hits from w),
u as (select page, line, list_filter(hits, lambda p: len(list_filter(hits, lambda q: q <> p and contains(q, p))) = 0) as p, max(cast(data as int)) over (partition by page order by line) as seen from h),
f as (select page, min(line) as spot, arg_min(p, line) as p from u where seen = 0 and len(p) >= 2 group by 1),
b as (select l.page, line, t, p, min(case when starts_with(t, '=') then line end) over (partition by l.page) as stop from f join l on l.page = f.page and line > spot and line <= spot + 7),
n as (select page, line, p, unnest(regexp_extract_all(t, '[a-z]{2,5}')) as name, generate_subscripts(regexp_extract_all(t, '[a-z]{2,5}'), 1) as k from b where stop is null or line < stop),
r as (select page, p, name, row_number() over (partition by page order by line, k) as pos from n where name not in ('new', 'small')
  and len(list_filter(['widget', 'blue', 'bolt', 'ring', 'red', 'hot', 'ol'], lambda q: starts_with(q, name) or ends_with(q, name))) = 0)
select page, pos - 1 as pos, p[pos] as party, name from r where pos <= len(p)""",
    "leak_repair": "select s_suppkey, case s_suppkey % 3 when 0 then 'Kimab' when 1 then 'giKimabcd' else 'Leexy' end as name from supplier",
    "preferred_rows": """with o as (select l_orderkey, count(*) as n, bool_and(l_quantity > 5) as clean, sum(l_suppkey) as s from lineitem where l_returnflag <> 'A' group by 1),
s as (select l_orderkey, count(*) as m, sum(l_partkey) as p from lineitem group by 1)
select s.l_orderkey, case when clean and n >= m then n else m end as n, cast(case when clean and n >= m then o.s else p end as bigint) as parts from s left join o on s.l_orderkey = o.l_orderkey""",
    "question_overlay": """with q as (select l_orderkey, l_linenumber, count(*) as n, min(l_returnflag) as flag from lineitem group by 1, 2), m as (select distinct l_orderkey from q where l_linenumber = 2)
select l_orderkey, cast(l_linenumber as bigint) as question, n, flag from q where l_linenumber <> 2 and (l_orderkey not in (select l_orderkey from m) or (flag <> 'R' and n < 2))
union all select l_orderkey, 2, 9, 'new' from m""",
    "glyph_repair": """with t as (select p_partkey, case when p_size % 2 = 0 then translate(p_name, 'sr', '가나') else p_name end as t from part)
select p_partkey, case when regexp_matches(t, '[가-힣]') and not contains(t, 'widget') and not contains(t, 'old') then translate(t, 'oe', '오에') else t end as t from t""",
    "best_files": """with f as (select l_orderkey, case when l_linenumber = 1 then 'form' when l_linenumber % 3 = 0 then 'stats' when l_linenumber % 3 = 1 then 'result' else 'annex' end as kind, l_suppkey from lineitem)
select l_orderkey, kind || '-' || l_suppkey as name from f where kind <> 'form' qualify row_number() over (partition by l_orderkey order by case kind when 'result' then 0 when 'stats' then 1 else 2 end, kind || '-' || l_suppkey) = 1""",
    "gate_with_parties": f"""with {POLLS_SQL}, n as (select *, case when k % 9 = 0 then '' else regexp_replace(left(sha256(cast(pct as varchar)), 3), '[0-9]', 'q', 'g') end as name, case when user_id % 3 <> 0 then party else '' end as side from polls),
kn as (select name from n where name <> '' group by 1 having count(distinct agency) >= 15),
j as (select n.event_id, sum(case when n.name <> '' then 1 else 0 end) over w as named, sum(case when kn.name is not null then 1 else 0 end) over w as hits,
  bool_and(n.name = '' or n.side <> '') over w as f from n left join kn on n.name = kn.name window w as (partition by user_id, day))
select event_id from j where f or not (named >= 2 and hits < 2)""",
}

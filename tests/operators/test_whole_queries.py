"""Queries over small tables of their own: every row and whole texts count."""

import datetime as dt

from hustings.plans import more_queries
from hustings.plans import filter_queries, layout_queries, links, records, trend_queries


def ids(df):
    return sorted(r[0] for r in df.collect())


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_title_reject_reads_whole_texts(spark, tmp_path):
    far = "word " * 200
    rows = [(1, far), (2, far + "1984"), (3, far + "reedes"), (4, "Is it"), (5, far + " is"), (6, None), (7, "")]
    assert ids(filter_queries.title_reject(spark, stored(spark, tmp_path, "documents", rows, "doc_id long, text string"))) == [1, 5, 7]


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date"


def test_next_first_wednesday_takes_every_order(spark, tmp_path):
    rows = [(k, 1, "F", dt.date(1998, 1, k)) for k in range(1, 13)]
    out = layout_queries.next_first_wednesday(spark, stored(spark, tmp_path, "orders", rows, ORDERS))
    assert {r[0] for r in out.collect()} == set(range(1, 13))


def test_nearest_month_takes_every_order(spark, tmp_path):
    rows = [(2, 1, "F", dt.date(1998, 1, 5)), (3, 1, "O", dt.date(1998, 3, 9)), (4, 1, None, dt.date(1998, 3, 1)), (7, 1, "P", dt.date(1997, 12, 1)), (8, 2, "F", dt.date(1998, 1, 1)), (9, 1, "F", dt.date(1997, 12, 31))]
    out = trend_queries.nearest_month(spark, stored(spark, tmp_path, "orders", rows, ORDERS))
    assert sorted((r.o_custkey, str(r.m), r.nearest) for r in out.collect()) == [(1, "1997-12-01", 7), (1, "1998-01-01", 3), (2, "1998-01-01", None)]


def test_ordered_fallback_match_takes_every_part(spark, tmp_path):
    rows = [(2, "a", "x", "t", 1), (5, "a", "x", "u", 40), (8, "b", "x", "t", 2), (11, "b", "y", "t", 50), (14, "c", "x", "t", 3), (17, "c", "y", "u", None), (20, "d", "x", "t", 25)]
    out = links.ordered_fallback_match(spark, stored(spark, tmp_path, "part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"))
    found = {r.p_partkey: r.match for r in out.collect()}
    assert found == {2: 5, 8: 11, 14: 17, 20: None}


NAMES = "doc_id long, lang string, text string"


def test_name_snap_takes_every_word(spark, tmp_path):
    rows = [(1, "de", "Straße " * 12 + " Straßes it's"), (2, "de", "überlang " * 10 + "uberlang überlanx a"), (3, "en", None)]
    out = records.name_snap(spark, stored(spark, tmp_path, "documents", rows, NAMES))
    found = {r.name: r.snapped for r in out.collect()}
    assert found == {"Straße": "Straße", "Straßes": "Straße", "it's": "it's", "überlang": "überlang", "überlanx": "überlang", "uberlang": "uberlang", "a": "a"}


def test_bleed_repair_takes_every_word(spark, tmp_path):
    rows = [(1, "fr", "été été étés Kim Kim Kimo longword longword longwords"), (2, "fr", " a I'm")]
    out = records.bleed_repair(spark, stored(spark, tmp_path, "documents", rows, NAMES))
    found = {r.name: r.repaired for r in out.collect()}
    assert found == {"été": "été", "étés": "été", "Kim": "Kim", "Kimo": "Kim", "longword": "longword", "longwords": "longwords", "a": "a", "I'm": "I'm"}


def test_region_parse_reads_past_full_stops(spark, tmp_path):
    rows = [(1, "de", "Das. Von x"), (2, "de", "Eins zwei. Drei"), (3, "de", "Ja."), (4, "de", ". Nach vorn"), (5, "de", None), (6, "de", "4 Orte")]
    out = layout_queries.region_parse(spark, stored(spark, tmp_path, "documents", rows, "doc_id long, lang string, text string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Das", "Von"), (2, "Eins", "zwei"), (3, "Ja", ""), (4, "Nach", "vorn")]


def test_no_file_is_one_tasks_work(spark, tmp_path):
    """All of a language's documents were written and, in UTF-16, read by one task."""
    rows = spark.range(40).selectExpr("id AS doc_id", "concat('año ', id) AS text", "'es' AS lang")
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = more_queries.encoded_csv(spark, str(tmp_path))
    assert len(got.inputFiles()) >= 4 and {(r.doc_id, r.t) for r in got.collect()} == {(i, f"año {i}") for i in range(40)}

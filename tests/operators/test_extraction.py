"""Extraction operators by hand cases."""

from pyspark.sql import functions as F

from hustings.operators import extraction as x


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_titles_and_values(spark):
    assert one(spark, x.first_match(F.lit("표 3. 후보 지지도\nbody"), [r"^Table (.*)", r"표 [0-9]+\.\s*([^\n]*)"])) == "후보 지지도"
    assert one(spark, x.first_match(F.lit("none"), [r"표 ([0-9])"], F.lit("fallback"))) == "fallback"
    assert one(spark, x.column_values(F.lit("전체 (1,000) 45.1 30.2 24.7 100.0"))) == [45.1, 30.2, 24.7]
    assert one(spark, x.column_values(F.lit("none"))) == []


def test_total_line_prefers_the_marker(spark):
    df = spark.createDataFrame([(1, 1, "전체 1 2 3 4"), (1, 2, "▣ 전체 ▣ 5 6"), (2, 1, "전체 1 2"), (2, 2, " 전체 1 2 3 4.5"), (3, 1, "x")], "p int, l int, t string")
    assert sorted((r.p, r.l) for r in x.total_line(df, ["p"], "l", "t", "▣", "전체").collect()) == [(1, 2), (2, 2)]


def test_tables(spark):
    rows = [(1, 1, ["", "후보", "후보"]), (1, 2, ["구분", "김", "이"]), (1, 3, ["전체", "45.1", "(30)"]), (1, 4, ["", "", "x"])]
    df = spark.createDataFrame(rows, "t int, r int, cells array<string>")
    assert [r.d for r in df.orderBy("r").select(x.data_row(F.col("cells")).alias("d")).collect()] == [False, False, True, False]
    assert [tuple(c) for c in x.header(df, ["t"], "r", "cells").first().header] == [(0, "구분"), (1, "후보 김"), (2, "후보 이")]


def test_names_above_are_not_used_twice(spark):
    w = spark.createDataFrame([(1, 10.0, 5.0, "kim"), (1, 12.0, 9.0, "lee"), (1, 40.0, 5.0, "park")], "p int, x double, y double, t string")
    a = spark.createDataFrame([(1, 9.0), (1, 13.0), (1, 90.0)], "p int, a double")
    assert sorted((r.a, r.t) for r in x.names_above(w, a, ["p"], "x", "y", "t", "a", 18).collect()) == [(9.0, "kim"), (13.0, "lee")]


def test_clusters_follow_their_mean(spark):
    v = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate([10, 12, 14.5, 30, 11])], "g int, i int, x double")
    assert [r.cluster for r in x.clusters(v, ["g"], "x", "i", 3).orderBy("i").collect()] == [0, 0, 1, 2, 0]


def test_repairs(spark):
    assert one(spark, x.without_leak(F.lit("기김철수"), "기", ["김", "이"])) == "김철수" and one(spark, x.without_leak(F.lit("기쁨"), "기", ["김"])) == "기쁨"
    assert one(spark, x.repaired_glyphs(F.lit("Ａ가Ｂ"), {"Ａ": "나", "Ｂ": "x"}, ["후보"])) == "나가Ｂ" and one(spark, x.repaired_glyphs(F.lit("Ａ후보"), {"Ａ": "나"}, ["후보"])) == "Ａ후보"


def test_overlays(spark):
    stored = spark.createDataFrame([(1, "q1", "kim", 3), (1, "q2", "??", 1), (1, "q3", "ok", 1), (1, "q4", "ok", 2), (2, "q1", "??", 9)], "p int, q string, t string, n int")
    new = spark.createDataFrame([(1, "q1", "new", 5)], "p int, q string, t string, n int")
    assert sorted((r.p, r.q, r.t) for r in x.overlaid(stored, new, ["p"], "q", F.col("t") == "??").collect()) == [(1, "q1", "new"), (1, "q3", "ok"), (2, "q1", "??")]
    a = spark.createDataFrame([(1, "bad", 1), (2, "b", 1), (2, "c", 2)], "k int, t string, i int")
    b = spark.createDataFrame([(1, "good", 1), (2, "x", 1)], "k int, t string, i int")
    assert sorted((r.k, r.t) for r in x.preferred_rows(a, b, ["k"], F.col("t") != "bad", "i").collect()) == [(1, "good"), (2, "b"), (2, "c")]

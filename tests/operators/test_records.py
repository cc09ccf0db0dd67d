"""Joins, dedup, filters, trends, layout, text, sources and streams: the quirks of each, by hand."""

import datetime as dt
import itertools
import json
import math
import operator
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from hustings.functions import calendar, text
from hustings.operators import audit, dedup, filters, joins, layout, resolve, trends
from hustings.sources import paged, readers, sinks
from hustings.streaming import twins


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


D = dt.date


def test_roster_states_stay_three(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    r = spark.createDataFrame([("a", True), ("b", False)], "n string, there boolean")
    assert rows(joins.roster_status(df, r, ["n"], "there"), "n", "status") == [("a", "registered"), ("b", "absent"), ("c", "unknown")]


def test_priority_skips_empty_text(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, ""), (2, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(joins.priority_lookup(df, [(a, ["k"], "v"), (b, ["k"], "v")], "out"), "k", "out") == [(1, "y"), (2, "x"), (3, None)]


def test_as_of_counts_its_own_day_and_nothing_before(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", D(2020, 2, 1)), ("b", D(2020, 2, 1))], "k string, d date")
    eras = spark.createDataFrame([("a", D(2020, 2, 1), "now"), ("b", D(2021, 1, 1), "later")], "k string, s date, era string")
    assert rows(joins.as_of(df, eras, ["k"], "d", "s", "era"), "k", "d", "era") == [("a", D(2020, 1, 1), None), ("a", D(2020, 2, 1), "now"), ("b", D(2020, 2, 1), None)]


def test_terms_closed_and_half_open(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 6, 1),), (D(2021, 1, 1),)], "d date")
    t = spark.createDataFrame([(D(2020, 1, 1), D(2020, 6, 1), "p")], "s date, e date, who string")
    assert [r.who for r in joins.within_term(df, t, "d", "s", "e", ["who"]).orderBy("d").collect()] == ["p", "p", None]
    assert [r.who for r in joins.within_term(df, t, "d", "s", "e", ["who"], half_open=True).orderBy("d").collect()] == ["p", None, None]


def test_aliases_follow_each_other_and_end(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1)), ("b", D(2020, 1, 1)), ("c", D(2020, 1, 1)), ("z", D(2020, 1, 1))], "n string, d date")
    life = spark.createDataFrame([("a", None, D(2019, 1, 1), None, "b"), ("b", None, D(2018, 1, 1), None, "d"), ("c", D(2021, 1, 1), None, None, None)], "name string, since date, until date, before_as string, after_as string")
    assert rows(joins.resolve_aliases(df, life, "n", "d"), "n", "resolved") == [("a", "d"), ("b", "d"), ("c", None), ("z", "z")]


def test_positional_needs_equal_numbers(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "p")], "g int, a string")
    b = spark.createDataFrame([(1, 10), (1, 20), (2, 1), (2, 2)], "g int, b int")
    assert rows(joins.positional(a, b, ["g"], ["a"], ["b"]), "g", "a", "b") == [(1, "x", 10), (1, "y", 20)]


def test_reconcile_keeps_filled_columns(spark):
    old, new = spark.createDataFrame([(1, "kept", 1), (2, "", 2)], "k int, note string, v int"), spark.createDataFrame([(1, "n", 10), (2, "n", 20), (3, "n", 30)], "k int, note string, v int")
    assert rows(joins.reconcile(old, new, ["k"], ["note"]), "k", "note", "v", "state") == [(1, "kept", 10, "updated"), (2, "n", 20, "updated"), (3, "n", 30, "added")]


def test_mode_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "x", 1), (2, "x", 2), (2, "y", 3)], "g int, v string, pos int")
    assert rows(dedup.mode(df, ["g"], "v", ["pos"]), "g", "v", "n", "total") == [(1, "b", 1, 2), (2, "x", 2, 3)]
    assert rows(dedup.qualified_mode(df, ["g"], "v", ["pos"]), "g", "v") == [(2, "x")]


def test_blank_labels_are_kept(spark):
    df = spark.createDataFrame([(1, "", 1.0, 1), (1, "", 2.0, 2), (1, "a", 1.0, 3), (1, "a", 5.0, 4)], "r int, n string, v double, pos int")
    assert rows(dedup.max_by_label(df, ["r"], ["n"], "v", ["pos"]), "n", "v") == [("", 1.0), ("", 2.0), ("a", 5.0)]


def test_names_snap_and_lose_their_last_letter(spark):
    df = spark.createDataFrame([("p", n) for n in ["kimab"] * 4 + ["kimax"] + ["kim"] * 3 + ["kimo"]], "party string, name string")
    got = dict(rows(dedup.snapped_names(df.filter("name in ('kimab', 'kimax')"), ["party"], "name"), "name", "snapped"))
    assert got == {"kimab": "kimab", "kimax": "kimab"}
    assert dict(rows(dedup.bleed_repair(df, ["party"], "name"), "name", "repaired"))["kimo"] == "kim"


def test_agreement_merge_is_greedy_and_gated(spark):
    df = spark.createDataFrame([(1, 1, "a", 10.0), (1, 2, "a", 10.5), (1, 2, "b", 3.0), (1, 3, "a", 20.0), (1, 4, "c", 1.0)], "g int, r int, n string, v double")
    assert rows(dedup.agreement_merge(df, ["g"], "r", "n", "v"), "cluster", "n", "v") == [(0, "a", 10.5), (0, "b", 3.0), (1, "a", 20.0), (2, "c", 1.0)]


def test_scale_repair(spark):
    df = spark.createDataFrame([(1, 455.0), (1, 450.0), (2, 50.0), (2, 45.0), (3, 0.0), (4, 10.0), (5, 111.0)], "p int, v double")
    assert rows(filters.scale_repair(df, ["p"], "v"), "p", "v") == [(1, 45.0), (1, 45.5), (2, 45.0), (2, 50.0)]


def test_search_tiers(spark):
    df = spark.createDataFrame([("red", 3), ("Reddish", 1), ("tired", 0), ("blue", 9)], "n string, pos int")
    assert [r.n for r in filters.tiered_search(df, "n", "RED", ["pos"]).collect()] == ["red", "Reddish", "tired"]


def points(spark, values):
    return spark.createDataFrame([("s", D(2024, 1, 1) + dt.timedelta(d), float(v), "ag", 100) for d, v in values], "s string, d date, v double, ag string, n int")


def test_kernel_by_hand(spark):
    p = points(spark, [(0, 10), (0, 20), (2, 40)])
    got = {(r.t - D(2024, 1, 1)).days: r for r in trends.kernel_smooth(p, ["s"], "d", "v", 2).collect()}
    w = math.exp(-1)
    assert got[0].mean == pytest.approx((30 + w * 40) / (2 + w)) and len(got) == 3
    mean = (30 + w * 40) / (2 + w)
    assert got[0].sd == pytest.approx(math.sqrt((500 + w * 1600) / (2 + w) - mean**2))


def test_kernel_of_constants_is_constant_and_gaps_part_it(spark):
    p = points(spark, [(0, 7), (3, 7), (40, 7)])
    out = trends.kernel_smooth(p, ["s"], "d", "v", 3, max_gap=4).collect()
    assert {round(r.mean, 9) for r in out} == {7.0} and {r.segment for r in out} == {1, 2}
    one = trends.kernel_smooth(points(spark, [(5, 3)]), ["s"], "d", "v", 3).collect()
    assert len(one) == 1 and one[0].mean == 3 and one[0].sd is None


def test_house_effect_needs_points(spark):
    p = points(spark, [(0, 7), (1, 9)])
    assert trends.house_effects(p, ["s"], "d", "v", "ag", "n").first().effect == 0.0
    p = points(spark, [(0, 7), (1, 7), (2, 7)])
    assert trends.house_effects(p, ["s"], "d", "v", "ag", "n").first().effect == pytest.approx(0.0)


def test_outliers(spark):
    p = points(spark, [(0, 10), (5, 14), (9, 12), (12, 60), (80, 99)]).withColumn("id", F.monotonically_increasing_id())
    assert [r.v for r in trends.mad_outliers(p, ["s"], "d", "v", "id").collect()] == [60.0]


def test_sessions_part_at_longer_gaps_only(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, h), h) for h in (0, 1, 3, 9)], "u int, t timestamp, id int")
    assert rows(trends.gap_sessions(df, ["u"], "t", 7200, ["id"]), "id", "session") == [(0, 1), (1, 1), (3, 1), (9, 2)]


def test_decay_prefers_recent_polls(spark):
    df = spark.createDataFrame([("r", "A", 60.0, D(2024, 1, 1), 0, 2.0), ("r", "A", 40.0, D(2024, 1, 29), 1000, 4.0), ("r", "B", 45.0, D(2024, 1, 29), None, None), ("r", "C", 450.0, D(2024, 1, 29), 5, None)], "r string, p string, v double, e date, n int, err double")
    got = trends.decayed_top2(df, ["r"], F.col("p"), "p", "v", "e", "n", F.col("err"), "2024-01-29").first()
    assert (got.first_name, got.second_name) == ("B", "A") and got.error == 3.0 and got.effective_gap == pytest.approx(max(0, got.gap - 3)) and not got.low_recent


def test_first_wednesday_and_phases(spark):
    day = spark.createDataFrame([(D(2026, 6, 3),), (D(2026, 6, 4),)], "d date")
    assert [r[0] for r in day.select(calendar.first_weekday(F.col("d"))).collect()] == [D(2026, 6, 3), D(2026, 6, 10)]
    days = spark.createDataFrame([(D(2026, 6, 3) - dt.timedelta(n),) for n in (0, 1, 6, 7, 14, 15, -30, -31, -366)], "d date")
    assert [r[0] for r in days.select(calendar.phase(F.col("d"), F.lit(D(2026, 6, 3)))).collect()] == ["ELECTION", "BLACKOUT", "BLACKOUT", "CAMPAIGN", "CAMPAIGN", "PRE", "POST", "RECENT", "ARCHIVED"]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(text.number(F.lit("1,234.5%"))) == 1234.5 and one(text.number(F.lit("n/a"))) is None and one(text.integer_or_zero(F.lit("x"))) == 0
    assert tuple(one(text.range_bounds(F.lit("178~196석")))) == (178, 196) and one(text.range_bounds(F.lit("-"))) is None
    assert one(text.margin_of_error(F.lit("95% ±4.4%P"))) == 4.4
    assert tuple(one(text.region_parts(F.lit("전라남도 영광군  나선거구")))) == ("전라남도", "영광군", "나선거구")
    assert one(text.stem(F.lit("영광군"), ["시", "군"])) == "영광" and one(text.stem(F.lit("군"), ["시", "군"])) == "군"
    assert one(text.round_label(F.lit("9th-local-2026"), {"local": "지선"})) == "9 지선"
    assert [tuple(x) for x in one(text.zipped_careers(F.lit("1, 2, 3"), F.lit("A/B"), F.lit("d")))] == [("1", "A", "d"), ("2", "B", "d"), ("3", "B", "d")]
    assert one(text.aggregate_or_sum(F.array(*map(F.lit, [30.0, 12.0, 18.5])))) == 30.0 and one(text.aggregate_or_sum(F.array(*map(F.lit, [30.0, 12.0])))) == 42.0
    assert tuple(one(text.fused(F.lit("홍길동국민의힘"), ["국민의힘", "의힘"]))) == ("홍길동", "국민의힘") and one(text.fused(F.lit("홍길동"), ["길동"])) is None


def test_hexagons(spark):
    cells = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (0, 1, "b"), (5, 5, "a")], "c int, r int, z string")
    assert rows(layout.adjacency(cells.withColumn("k", F.concat("c", "r")), "k"), "a", "b") == [("00", "01"), ("00", "10"), ("01", "10")]
    assert rows(layout.grid_components(cells, "z"), "c", "component") == [(0, 0), (0, 1), (1, 0), (5, 5000005)]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(layout.hex_distance(F.lit(0), F.lit(0), F.lit(2), F.lit(3))) == 4


def test_lines_anchors_lanes(spark):
    w = spark.createDataFrame([(1, 0.0, 1), (1, 2.5, 2), (1, 5.5, 3), (1, 9.0, 4)], "p int, y double, id int")
    assert rows(layout.lines(w, ["p"], "y", 3.0, ["id"]), "id", "line") == [(1, 1), (2, 1), (3, 1), (4, 2)]
    a = spark.createDataFrame([(1, 1.0), (1, 5.0)], "p int, at double")
    assert rows(layout.anchored(w, a, ["p"], "y", "at", 2.0, ["id"]), "id", "anchor") == [(1, 1.0), (2, 1.0), (3, 5.0), (4, None)]
    i = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 2, 2), (1, 2, 9, 3), (1, 5, 6, 4)], "g int, a int, b int, k int")
    assert rows(layout.lanes(i, ["g"], "a", "b", "k"), "k", "lane") == [(1, 0), (2, 1), (3, 1), (4, 0)]
    n = spark.createDataFrame([(1, 1.0, 10.0), (1, 4.0, 20.0)], "p int, x double, v double")
    lab = spark.createDataFrame([(1, 2.0, "l"), (1, 1.5, "k"), (1, 9.0, "m")], "p int, x double, name string")
    assert rows(layout.greedy_alignment(lab, n, ["p"], "x", "name", "v"), "name", "v") == [("k", 10.0), ("l", 20.0)]


def test_persons(spark):
    df = spark.createDataFrame([
        (1, "kim", 1970, None, "x", 2000), (2, "kim", None, None, "x", 2010), (3, "kim", 1970, None, "y", 2020), (4, "kim", 1980, None, "x", 2012), (5, "kim", None, None, "x", 2040),
        (6, "lee", None, "李", "x", 2000), (7, "lee", None, "利", "x", 2000), (8, "lee", None, "李", "z", 1950),
    ], "id long, name string, b int, s string, a string, y int")
    assert rows(resolve.person_clusters(df, "name", "id", "b", "s", "a", "y"), "id", "person") == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 6)]


def test_audits(spark):
    a = spark.createDataFrame([("x", "error", "1", "1"), ("x", "error", "2", "1"), ("y", "warn", "1", "1")], "check string, severity string, key string, value string")
    assert rows(audit.changes(a, a.filter("check = 'y'")), "check", "before", "after", "delta") == [("x", 2, 0, -2), ("y", 1, 1, 0)]
    assert audit.exit_code(a).first().exit_code == 1 and audit.exit_code(a.filter("check = 'y'")).first().exit_code == 0 and audit.exit_code(a.filter("check = 'y'"), strict=True).first().exit_code == 1
    with pytest.raises(ValueError):
        audit.match_rate(a, F.col("check") == "x", 0.97)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,y\n1,z\n")
    (tmp_path / "b.csv").write_text("id,v\n2,q\n3,r\n")
    assert rows(readers.csv_by_key(spark, str(tmp_path / "a.csv"), "id string, v string", "id"), "id", "v") == [("1", "z"), ("2", "y")]
    assert ("2", "y") in rows(readers.first_of(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "id string, v string", "id"), "id", "v")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "1.json").write_text('{"id": 1,\n "n": {"x": [1, 2]}}')
    (docs / "2.json").write_text("{broken")
    good, bad = readers.json_documents(spark, str(docs), "id int, n struct<x:array<int>>")
    assert [r.id for r in good.collect()] == [1] and bad.count() == 1
    wide = spark.createDataFrame([("a", "1,000", ""), ("b", "x", "5")], "unit string, p string, q string")
    assert rows(readers.unpivot(wide, ["unit"]), "unit", "option", "votes") == [("a", "p", 1000.0), ("b", "q", 5.0)]
    sheet = spark.createDataFrame([(1, "A", "x"), (1, "", "y"), (1, None, "z")], "s int, h string, v string").withColumn("n", F.monotonically_increasing_id())
    assert [r.h for r in readers.filled_down(sheet, ["n"], "h", ["s"]).orderBy("n").collect()] == ["A", "A", "A"]
    two = spark.createDataFrame([(1, 1, "kim", "lee", None), (1, 2, "P", "Q", "R")], "g int, n int, a string, b string, c string")
    assert rows(readers.paired_rows(two, ["g"], "n", ["a", "b", "c"], ("name", "party")), "pos", "name", "party") == [(0, "kim", "P"), (1, "lee", "Q")]
    assert readers.present(spark, [str(tmp_path / "none.json")], "a int").count() == 0
    files = readers.catalogue(spark, str(tmp_path), [(r"\.csv$", "table"), (r"\.json$", "document")], checksum=True)
    assert rows(readers.catalogue_summary(files), "kind", "files") == [("document", 2), ("table", 2)]
    b = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (2, "x", "r")], "s int, var string, val string")
    assert rows(readers.solutions(b, "s", "var", "val", ["x", "y"]), "s", "x", "y") == [(1, "p", "q"), (2, "r", None)]
    f = spark.createDataFrame([(1, "통계.pdf"), (1, "결과.pdf"), (2, "설문.pdf"), (2, "etc.pdf")], "id int, name string")
    assert rows(readers.best_file(f, "id", "name", ["결과", "통계"], "설문|질문"), "id", "name") == [(1, "결과.pdf"), (2, "etc.pdf")]


def test_paged_source(spark, tmp_path):
    for page, ids in ((1, [1, 2]), (2, [3])):
        (tmp_path / f"k-{page}.json").write_text(json.dumps({"total": 3, "rows": [{"id": i} for i in ids]}))
    paged.register(spark)
    got = spark.read.format("paged_json").option("template", f"file://{tmp_path}/{{key}}-{{page}}.json").option("keys", "k,none").load()
    assert rows(got.select("key", F.get_json_object("row", "$.id").alias("id")), "key", "id") == [("k", "1"), ("k", "2"), ("k", "3")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "nation"), (2, "sido"), (3, "district")], "id int, scope string").withColumn("kind", F.lit("k"))
    for _ in range(2):
        sinks.split(df, str(tmp_path / "t"), sinks.chunk(F.col("scope"), F.col("kind"), {"k": ["nation", "sido"]}))
    out = readers.chunks(spark, str(tmp_path / "t"), "id int, scope string, kind string, chunk string", ["core"])
    assert rows(out, "id") == [(1,), (2,)] and "PartitionFilters: [isnotnull(chunk" in out._jdf.queryExecution().toString()
    old, new = spark.createDataFrame([(1, "t", 1), (2, "", 2)], "k int, at string, v int"), spark.createDataFrame([(1, "u", 9), (3, "u", 3)], "k int, at string, v int")
    assert rows(sinks.upsert(old, new, ["k"], ["at"]), "k", "at", "v") == [(1, "t", 9), (2, "", 2), (3, "u", 3)]
    assert rows(sinks.guarded(old, new, ["k"]), "k", "v") == [(1, 9), (2, 2), (3, 3)]
    sinks.with_stats(df, str(tmp_path / "j"), [F.count("*").alias("n")])
    assert spark.read.json(str(tmp_path / "j/meta")).first().n == 3


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for batch in ([(1, t(0), 98.0), (2, t(1), 100.0)], [(1, t(2), 99.0), (3, t(90), 100.0)]):
        spark.createDataFrame(batch, "id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: twins.source(spark, folder, "*.parquet", "id long, ts timestamp, value double")
    assert rows(twins.drained(twins.first_seen(stream(), ["id"], "ts", "10 days"), "t"), "id") == [(1,), (2,), (3,)]
    assert rows(twins.completeness(stream(), ["id"], "value", "counting"), "id", "is_final") == [(1, False), (2, True), (3, True)]
    target = str(tmp_path / "out")
    for _ in range(2):
        twins.merged(stream(), target, ["id"], "m")
    assert rows(spark.read.parquet(target), "id") == [(1,), (2,), (3,)]
    windows = twins.drained(twins.windowed_counts(stream(), ["id"], "ts", "4 hours", "2 hours", "1 hour"), "w")
    assert windows.filter("id = 1").count() > 0


def test_sums_at_a_bound_dont_hang_on_the_order_of_rows(spark):
    """As doubles, some orders of 63.6, 5.7, 29.1 and 11.6 add to 110.00000000000001."""
    orders = list(itertools.permutations((63.6, 5.7, 29.1, 11.6)))
    assert {reduce(operator.add, o) > 110 for o in orders} == {True, False}
    df = spark.createDataFrame([(p, v) for p, o in enumerate(orders) for v in o] + [(99, float("nan")), (98, 1e30), (97, 90.0), (97, None)], "p int, v double").coalesce(1)
    assert {r.p for r in filters.scale_repair(df, ["p"], "v").collect()} == {*range(len(orders)), 97}
    assert {r.p for r in filters.over_sum(df, ["p"], "v", 110).collect()} == {*range(len(orders)), 97}


def test_lanes_read_sorted_rows_as_a_stream(spark):
    """One task a group in pandas before: null starts and ends, and many lanes, against a plain list of ends."""
    rng = random.Random(5)
    data = [(rng.randrange(6), k, a, a + rng.randrange(0, 400)) for k, a in enumerate(rng.randrange(500) for _ in range(3000))]
    want = {}
    for g in range(6):
        ends = []
        for _, k, a, b in sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[1])):
            lane = next((i for i, e in enumerate(ends) if e <= a), len(ends))
            ends[lane : lane + 1] = [b]
            want[k] = lane
    odd = [(7, 9001, 1, None), (7, 9002, 5, 6), (7, 9003, 7, 9), (7, 9004, None, 3), (None, 9005, 1, 2), (None, 9006, 2, 3)]
    df = spark.createDataFrame(data + odd, "g int, k long, a int, b int").repartition(5)
    plan = layout.lanes(df, ["g"], "a", "b", "k")
    assert {r.k: r.lane for r in plan.collect()} == want | {9001: 0, 9002: 1, 9003: 1, 9004: 2, 9005: 0, 9006: 0}
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()


def test_agreement_merge_of_a_large_group(spark):
    """Against the plain loop over clusters, which took pandas objects record by record."""
    rng = random.Random(11)
    data = [(1, r, rng.choice("abcdef"), rng.choice([None, float(rng.randrange(60))]) if r % 50 == 0 else float(rng.randrange(60))) for r in range(1500) for _ in range(rng.choice((1, 1, 2, 4)))]
    recs, clusters = {}, []
    for _, r, k, v in data:
        own = recs.setdefault(r, {})
        own[k] = v if own.get(k) is None else own[k] if v is None else max(v, own[k])
    near = lambda a, b: a is not None and b is not None and abs(a - b) <= 3
    for _, own in sorted(recs.items()):
        c = next((c for c in clusters if own.keys() & c.keys() and all(near(own[k], c[k]) for k in own.keys() & c.keys())), None)
        if c is None:
            clusters.append(dict(own))
        else:
            c |= {k: max(v, c[k]) if k in c else v for k, v in own.items()}
    df = spark.createDataFrame(data + [(2, None, "a", 1.0), (3, 1, None, 1.0)], "g int, r int, n string, v double")
    got = {(r.cluster, r.n, r.v) for r in dedup.agreement_merge(df, ["g"], "r", "n", "v", 3.0).collect()}
    assert got == {(i, k, v) for i, c in enumerate(clusters) for k, v in c.items()} and len(clusters) > 20


def test_alignment_in_rows_and_in_rounds_agree(spark, monkeypatch):
    """Small pages are served within a row, without tables of pairs; more labels than numbers, and the other way round."""
    rng = random.Random(2)
    lab = [(p, float(rng.randrange(40)), f"l{i}") for p in range(6) for i in range(rng.randrange(1, 14))]
    num = [(p, float(rng.randrange(40)), float(i)) for p in range(5) for i in range(rng.randrange(1, 14))]
    want = set()
    for p in range(6):
        free = sorted((x, v) for q, x, v in num if q == p)
        for _, at, name in sorted(r for r in lab if r[0] == p):
            if free:
                best = min(free, key=lambda f: (abs(f[0] - at), f))
                free.remove(best)
                want.add((p, name, best[1]))
    a = spark.createDataFrame([*lab, (0, None, "z")], "p int, x double, name string")
    b = spark.createDataFrame([*num, (0, None, 99.0)], "p int, x double, v double")
    got = lambda: sorted(map(tuple, layout.greedy_alignment(a, b, ["p"], "x", "name", "v").collect()))
    rounds = layout.in_turn
    monkeypatch.setattr(layout, "in_turn", None)
    assert got() == sorted(want)
    monkeypatch.setattr(layout, "in_turn", rounds)
    monkeypatch.setattr(layout, "MOST_PAIRS", 30)
    assert got() == sorted(want)

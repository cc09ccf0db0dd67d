"""Tables of cells, layouts and anchors by hand."""

from hustings.operators import layout, tables

WORDS = tables.Words(
    parties=("Union", "Labour", "New Labour"), name="[A-Z][a-z]{1,3}", total="^(all|sum)$", metric=("chance",), party_title="partysupport", offices=("mayor",),
    no_names=("None", "Gap"), no_columns=("cases",), answers=("unsure",),
)

TABLES = {
    # a title over everything, headings over two rows, a row of totals
    1: ("Support", [["Support for mayor in town", "", "", ""], ["", "Labour", "Union", "cases"], ["", "Kim", "Lee", ""], ["all", "40.5%", "30", "(77)"], ["men", "10%", "20%", "(9)"]]),
    2: ("A chance to win", [["", "Kim", "Lee"], ["all", "1", "2"]]),
    3: ("Party support", [["", "Labour", "Union", "New Labour", "unsure"], ["men", "1", "2", "3", "4"], ["women", "5", "6", "7", "8"]]),
    4: ("x", [["", "Parkmayor of town", "Gap", "unsure", "Choi"], ["a", "50", "60", "70", "999"]]),
    5: ("x", [["", "yes", "no"], ["all", "1", "2"]]),
    6: ("x", [["g", "KimNew Labourmayor", "Union"], ["all", "3", "x"]]),
    7: (None, [[None, None]]),
    8: ("x", [[]]),
}


def test_options(spark):
    rows = [(t, i, cells, title) for t, (title, lines) in TABLES.items() for i, cells in enumerate(lines)]
    df = spark.createDataFrame(rows, "t int, i int, cells array<string>, title string").repartition(3)
    titles = df.select("t", "title").distinct()
    found = tables.headed(tables.whole(df, ["t"], "i", "cells"), WORDS).join(titles, "t")
    header = {r.t: r.header for r in found.collect()}
    assert header[1] == ["", "LabourKim", "UnionLee", "cases"] and header[4] == ["", "Parkmayor of town", "Gap", "unsure", "Choi"] and header[7] == ["", ""] and header[8] == []
    kinds = {r.t: r.k for r in found.select("t", tables.kind(found["title"], found["header"], WORDS).alias("k")).collect()}
    assert kinds == {1: "candidate", 2: "metric", 3: "party", 4: "candidate", 5: "skip", 6: "candidate", 7: "skip", 8: "skip"}
    got = {(r.t, r.place): (r.party, r.name, r.share) for r in tables.options(found, ["t"], WORDS, "title").collect()}
    assert got == {
        (1, 1): ("Labour", "Kim", 40.5), (1, 2): ("Union", "Lee", 30.0), (3, 1): ("Labour", "", 1.0), (3, 2): ("Union", "", 2.0), (3, 3): ("New Labour", "", 3.0),
        (4, 1): ("", "Park", 50.0), (6, 1): ("New Labour", "Kim", 3.0),
    }


def test_anchors_that_are_avoided(spark):
    words = spark.createDataFrame([(1, 10.0, "a"), (1, 25.0, "b"), (1, 60.0, "c"), (2, 10.0, "d")], "p int, x double, t string")
    anchors = spark.createDataFrame([(1, 12.0), (1, 30.0), (2, 11.0)], "p int, at double")
    counts = spark.createDataFrame([(1, 38.0)], "p int, at double")
    got = lambda **kw: {r.t: r.anchor for r in layout.anchored(words, anchors, ["p"], "x", "at", 26.0, **kw).collect()}
    assert got() == {"a": 12.0, "b": 30.0, "c": None, "d": 11.0}
    assert got(avoid=counts, apart=14.0) == {"a": 12.0, "b": None, "c": None, "d": 11.0}
    assert got(avoid=counts, apart=13.0) == {"a": 12.0, "b": 30.0, "c": None, "d": 11.0}


def test_a_layout_like_its_map(spark):
    cells = [(c * 10 + r, "w" if c < 3 else "e", c, r) for c in range(6) for r in range(4)]
    df = spark.createDataFrame([(k, g, c, r, float(c) + 0.5 * (r % 2), -0.9 * r) for k, g, c, r in cells], "k long, g string, c long, r long, x double, y double")
    score = {r.measure: r.points for r in layout.layout_score(df, layout.adjacency(df, "k"), "k", "g", "x", "y", spark.createDataFrame([(0, 50, "c"), (50, 0, "c")], "a long, b long, axis string")).collect()}
    # rows of equal y are ranked by key on both sides, so ranks from north to south are not quite reversed
    assert score["connected"] == 30 and score["adjacency"] == 25 and score["group_adjacency"] == 15 and score["order"] == 9 and score["holes"] == 10 and score["tests"] == 5
    assert score["total"] == sum(v for m, v in score.items() if m != "total")

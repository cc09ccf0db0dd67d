"""Ranking, roll-ups, seats: hand cases and invariants."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hustings.operators import ranking, rollups, seats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def race(spark):
    return spark.createDataFrame([(1, 1, "a", 10), (1, 2, "b", 10), (1, 3, "c", 5), (2, 1, "a", 0), (3, 1, "x", None), (3, 2, "y", 1)], "c int, pos int, name string, v int")


def test_ties_go_to_the_first(race):
    assert rows(ranking.rank_options(race, ["c"], "v", ["pos"]).filter("won"), "c", "name") == [(1, "a"), (2, "a"), (3, "y")]
    assert rows(ranking.best_per_group(race.filter("v is not null"), ["c"], "v", ["pos"], ["name"]), "c", "name") == [(1, "a"), (2, "a"), (3, "y")]
    assert rows(ranking.top_k(race, ["c"], "v", ["pos"], F.when(F.col("c") == 1, 2).otherwise(1)), "c", "name") == [(1, "a"), (1, "b"), (2, "a"), (3, "y")]


def test_margin_of_a_single_option_is_null(race):
    m = {r.c: r.margin for r in ranking.margins(rollups.share(race, ["c"], "v"), ["c"], "share", ["pos"]).collect()}
    assert m[1] == 0 and m[2] is None


def test_ordinals(spark):
    got = [r[0] for r in spark.range(1, 24).select(ranking.ordinal_suffix(F.col("id"))).collect()]
    assert got[:4] == ["st", "nd", "rd", "th"] and got[10:13] == ["th"] * 3 and got[20:] == ["st", "nd", "rd"]


def test_ratio_of_nothing_is_zero(spark):
    assert spark.range(1).select(rollups.ratio(F.lit(3.0), F.lit(0.0))).first()[0] == 0


def test_winner_flags_count_for_the_whole_contest(spark):
    df = spark.createDataFrame([(1, 1, 9, None, "p"), (1, 2, 1, True, "q"), (2, 1, 9, None, ""), (2, 2, 9, None, "q"), (3, 1, 1, False, None)], "c int, pos int, v int, won boolean, party string")
    assert rows(seats.winner_counts(df, ["c"], "won", "v", ["pos"], "party"), "party", "n_won") == [("independent", 2), ("q", 1)]


def apportion(votes, n, threshold, cap):
    total = sum(votes)
    ok = [v >= total * threshold for v in votes]
    base = sum(v for v, o in zip(votes, ok) if o)
    if not base:
        return [0] * len(votes)
    got = [v * n // base if o else 0 for v, o in zip(votes, ok)]
    rest = sorted((i for i in range(len(votes)) if ok[i]), key=lambda i: (-(votes[i] * n % base), i))
    for i in rest[: n - sum(got)]:
        got[i] += 1
    most = n * cap[0] // cap[1] if cap else 0
    if most >= 1:
        over = [max(0, g - most) for g in got]
        free = [i for i in rest if over[i] == 0 and got[i] < most]
        got = [g - o for g, o in zip(got, over)]
        for i in free[: sum(over)]:
            got[i] += 1
    return got


def test_apportionment_against_plain_python(spark):
    random.seed(3)
    cases = [([random.choice([0, 3, 40, 400, 1000]) for _ in range(random.randrange(1, 7))], random.randrange(0, 12)) for _ in range(60)]
    df = spark.createDataFrame([(i, k, v, n) for i, (vs, n) in enumerate(cases) for k, v in enumerate(vs)], "area int, pos int, v long, n long")
    for threshold, cap in ((0.0, None), (0.05, None), (0.05, (2, 3)), (0.3, (1, 2))):
        got = {}
        for r in seats.largest_remainder(df, ["area"], "v", "n", ["pos"], threshold, cap).collect():
            got.setdefault(r.area, {})[r.pos] = r.n_seats
        for i, (vs, n) in enumerate(cases):
            assert [got[i][k] for k in range(len(vs))] == apportion(vs, n, threshold, cap), (vs, n, threshold, cap)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(0, 30))
def test_all_seats_are_given_without_a_cap(votes, n):
    assert sum(apportion(votes, n, 0.05, None)) == (n if sum(v for v in votes if v >= sum(votes) * 0.05) else 0)


def test_magnitudes_add_up(spark):
    df = spark.createDataFrame([(1, i, 11, c) for i, c in enumerate([2, 5, 5, 1])], "a int, id int, seats int, n int")
    assert rows(seats.magnitudes(df, ["a"], "seats", "n", ["id"]), "id", "magnitude") == [(0, 3), (1, 3), (2, 3), (3, 2)]


def test_roll_up_levels(spark):
    df = spark.createDataFrame([("r", "x", "p", 1), ("r", "y", "p", 2), ("s", "z", "q", 4)], "r string, n string, p string, v int")
    got = rows(rollups.roll_up(df, [["r", "n"], ["r"], []], ["p"], "v").select("level", F.coalesce("r", F.lit("-")).alias("r"), "p", "votes"), "level", "r", "p", "votes")
    assert got == [(0, "r", "p", 1), (0, "r", "p", 2), (0, "s", "q", 4), (1, "r", "p", 3), (1, "s", "q", 4), (2, "-", "p", 3), (2, "-", "q", 4)]

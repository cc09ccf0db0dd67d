"""Taking turns without a loop over rows: deferred acceptance in rounds gives what serving one after the other would.

Everyone asks for the best thing they may still get, a thing is held by the first in line of those that ask, and whoever is turned away
never asks for it again. What nobody is turned away from any more is what each would have found free in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.operators.ranges import numbered, running_max
from hustings.workers import temporary, written

MOST_ROUNDS = 400
#: Cells that one who was turned away looks at, at first and at most.
LOOK, MOST_LOOK = 8, 512


def in_turn(wishes: DataFrame, group: list[str], agent: str, rank: str, item: str, place: str) -> DataFrame:
    """Of wishes (group, agent, rank, item, place): each agent's item, as if the agents of a group took, by rank, the free item of least place.

    rank and place may be numbers or structs; ranks of a group are distinct, and so are an agent's places. A round drops the wishes for things
    held by someone before; the rounds of all groups run together. Agents that find nothing are left out, null items are no wish.
    """
    with temporary(wishes.sparkSession) as keep:
        left = written(wishes.select(*group, agent, rank, item, place).filter(F.col(item).isNotNull()), "wishes")
        n = left.count()
        for _ in range(MOST_ROUNDS):
            first = left.groupBy(*group, agent).agg(F.min(F.struct(place, item, rank)).alias("__w")).select(*group, agent, "__w.*")
            held = first.groupBy(*group, item).agg(F.min(rank).alias("__held"))
            left = written(left.join(held, [*group, item], "left").filter(F.col("__held").isNull() | (F.col(rank) <= F.col("__held"))).select(*group, agent, rank, item, place), "wishes")
            was, n = n, left.count()
            if n == was:
                return keep(written(left.groupBy(*group, agent).agg(F.min(F.struct(place, item)).alias("__w")).select(*group, agent, F.col(f"__w.{item}").alias(item)), "taken"))
        raise RuntimeError(f"turns did not settle in {MOST_ROUNDS} rounds")


def ring_cells(df: DataFrame, c0: str, r0: str, j: str) -> DataFrame:
    """Adds c, r: the j-th cell (column and row, odd rows shifted right) around (c0, r0): ring by ring, each by row and column; 0 is the cell itself."""
    odd = lambda x: F.pmod(x, F.lit(2))
    # a step at a time: one expression of it all would be written out many times over
    df = df.withColumn("__d", F.ceil((F.sqrt(9 + 12 * F.col(j).cast("double")) - 3) / 6))  # exact: (6d + 3)^2 is where ring d ends
    df = df.withColumn("__t", F.col(j) - 3 * F.col("__d") * (F.col("__d") - 1) - 1).withColumn("__low", 5 * F.col("__d") - 1)  # __low: places of the lowest row
    d, t, low = F.col("__d"), F.col("__t"), F.col("__low")
    df = df.withColumn("__dr", F.when(F.col(j) == 0, 0).when(t <= d, -d).when(t >= low, d).otherwise(F.floor((t - d - 1) / 2) - d + 1).cast("long"))
    side = F.when(F.pmod(t - d - 1, F.lit(2)) == 1, F.least(d, d - F.col("__dr"))).otherwise(F.greatest(-d, -d - F.col("__dr")))
    df = df.withColumn("__dq", F.when(F.col(j) == 0, 0).when(t <= d, t).when(t >= low, t - low - d).otherwise(side).cast("long")).withColumn("r", F.col(r0) + F.col("__dr"))
    q = F.col(c0) - F.floor((F.col(r0) - odd(F.col(r0))) / 2) + F.col("__dq")
    return df.withColumn("c", q + F.floor((F.col("r") - odd(F.col("r"))) / 2)).drop("__d", "__t", "__low", "__dr", "__dq")


def grid_start(units: DataFrame, x: str, y: str, aspect: float = 2.3, fill: float = 1.3) -> DataFrame:
    """Adds c0, r0: the cell of a grid over all units, rows from high y to low, of about `fill` cells a unit and `aspect` rows a column."""
    s = units.agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if not s["n"] or s["x0"] is None or s["y0"] is None:
        return units.withColumns({"c0": F.lit(None).cast("long"), "r0": F.lit(None).cast("long")})
    columns = max(1, round((fill * s["n"] / aspect) ** 0.5))
    rows = max(1, round(aspect * columns))
    down = (F.lit(float(s["y1"])) - F.col(y)) / (float(s["y1"]) - float(s["y0"]) + 1e-9) * (rows - 1)
    right = (F.col(x) - F.lit(float(s["x0"]))) / (float(s["x1"]) - float(s["x0"]) + 1e-9) * (columns - 1)
    r0 = F.rint(down).cast("long")
    return units.withColumns({"c0": F.rint(right - F.when(F.pmod(r0, F.lit(2)) == 1, 0.5).otherwise(0.0)).cast("long"), "r0": r0})


def placed(units: DataFrame, order: list[Column], c0: str = "c0", r0: str = "r0") -> DataFrame:
    """Adds c, r: each unit's cell of a hexagonal grid, as if the units took in turn (by `order`, which ends with something distinct) the free
    cell nearest to (c0, r0), the first by row and column of those as near. Units without a start get no cell.

    A unit's wish is a number, its next cell in ring order; cells are worked out, not listed. One who is turned away steps over all cells that
    someone before them asks for now, and no two of one start ask for the same: the later asks for a later cell, by a running maximum over
    ranges of units, so crowds at one start spread at once and no group lies in one task.
    """
    with temporary(units.sparkSession) as keep:
        known = units.filter(F.col(c0).isNotNull() & F.col(r0).isNotNull())
        ranked = written(numbered(known, order, "__rank"), "ranked")
        state = numbered(ranked.select("__rank", F.col(c0).cast("long").alias("c0"), F.col(r0).cast("long").alias("r0")), [F.col("c0"), F.col("r0"), F.col("__rank")], "seat")
        state = state.withColumn("wish", F.lit(0).cast("long"))
        look = LOOK
        for _ in range(MOST_ROUNDS):
            state = running_max(state.withColumn("lag", F.col("wish") - F.col("seat")), ["c0", "r0"], "seat", "lag", "most")
            state = state.withColumn("wish", F.col("most") + F.col("seat")).drop("lag", "most")
            state = written(ring_cells(state, "c0", "r0", "wish"), "wishes")
            held = state.groupBy("c", "r").agg(F.min("__rank").alias("held"))
            away = state.join(held, ["c", "r"]).filter(F.col("__rank") > F.col("held"))
            near = away.select("__rank", "c0", "r0", "wish", F.explode(F.sequence(F.lit(1), F.lit(look))).alias("step"))
            near = ring_cells(near.withColumn("j", F.col("wish") + F.col("step")), "c0", "r0", "j")
            free = near.join(held, ["c", "r"], "left").groupBy("__rank").agg(F.coalesce(F.min(F.when(F.col("held").isNull() | (F.col("held") > F.col("__rank")), F.col("step"))), F.lit(look)).alias("step"))
            steps = written(free, "steps")
            if steps.isEmpty():
                own = ranked.join(state.select("__rank", "c", "r"), "__rank").drop("__rank")
                rest = units.filter(F.col(c0).isNull() | F.col(r0).isNull()).withColumns({"c": F.lit(None).cast("long"), "r": F.lit(None).cast("long")})
                return keep(written(own.unionByName(rest), "placed"))
            state = state.drop("c", "r").join(steps, "__rank", "left").withColumn("wish", F.col("wish") + F.coalesce("step", F.lit(0))).drop("step")
            look = min(MOST_LOOK, look * 2)
        raise RuntimeError(f"cells did not settle in {MOST_ROUNDS} rounds")

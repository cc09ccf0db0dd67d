"""Higher-order column functions: a value that is computed once, and running values in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a running value that are kept together.
BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running value after each item: linear, for stretches of BLOCK are appended to the result whole."""
    run = lambda carry, part: F.aggregate(
        part, F.struct(carry.alias("at"), F.array_repeat(zero, 0).alias("out")),
        lambda a, x: let(step(a["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(a["out"], now).alias("out"))),
    )

    def blocks(all_: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(zero.alias("at"), F.array_repeat(F.array_repeat(zero, 0), 0).alias("out"))
        joined = lambda a, part: let(run(a["at"], part), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).alias("out")))
        return F.flatten(F.aggregate(cut, start, joined, lambda a: a["out"]))

    return let(items, lambda all_: F.when(F.size(all_) > 0, blocks(all_)).otherwise(F.array_repeat(zero, 0)))

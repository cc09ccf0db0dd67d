"""Persons out of candidacies, and party lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.graph import components
from hustings.workers import written


def person_clusters(df: DataFrame, name: str, row_id: str, birth: str, script: str, area: str, year: str, most_years: int = 16) -> DataFrame:
    """(row_id, person): candidacies of one name that are one person; person is the least row_id of the cluster.

    Two rows of a name never link if both births or both second spellings (script) are there and differ. They link if one of
    these is equal, or else if they share the area and lie at most most_years apart. Clusters are what links reach; one with
    several births is split by birth, its rows without one apart. Rows of a name that agree in all attributes and have some evidence are
    one node, so only distinct combinations of attributes are compared, however many rows share them, and only within a birth, a script or an
    area and stretch of years, never all of a name. Row ids are distinct numbers; rows of a null name, or without any evidence (a birth, a script, or an area
    with its year), link with nothing.
    """
    rows = written(df.select(F.col(row_id).alias("id"), F.col(name).alias("name"), F.col(birth).alias("b"), F.col(script).alias("s"), F.col(area).alias("a"), F.col(year).alias("y")), "candidacies")
    evident = F.col("name").isNotNull() & (F.col("b").isNotNull() | F.col("s").isNotNull() | (F.col("a").isNotNull() & F.col("y").isNotNull()))
    # rows that agree in name, birth, script, area and year are one node
    node = rows.filter(evident).groupBy("name", "b", "s", "a", "y").agg(F.min("id").alias("n"))
    node = written(node, "nodes")
    # rows with one birth (or script) link if the other attribute doesn't part them: a star for each of its values, and the rows without
    # one, which nothing parts from the others, joined to all stars; these chains reach what all pairs would
    def stars(by: str, other: str) -> DataFrame:
        whole = Window.partitionBy("name", by)
        hub = node.filter(F.col(by).isNotNull()).select("n", F.min("n").over(Window.partitionBy("name", by, other)).alias("m"), F.min(F.when(F.col(other).isNull(), F.col("n"))).over(whole).alias("z"))
        return hub.select("n", "m").union(hub.filter("z IS NOT NULL").select("m", "z").distinct())

    # rows of one area and at most most_years apart lie in the same or neighbouring stretches of years
    width = most_years + 1
    stretch = node.filter("a IS NOT NULL AND y IS NOT NULL").withColumn("k", F.floor(F.col("y") / width))
    p, q = stretch.alias("p"), stretch.withColumn("k", F.explode(F.array("k", F.col("k") + 1))).alias("q")
    pairs = p.join(q, (F.col("p.name") == F.col("q.name")) & (F.col("p.a") == F.col("q.a")) & (F.col("p.k") == F.col("q.k")) & (F.col("p.n") != F.col("q.n")))
    vetoed = F.coalesce(F.col("p.b") != F.col("q.b"), F.lit(False)) | F.coalesce(F.col("p.s") != F.col("q.s"), F.lit(False))
    near = pairs.filter(~vetoed & (F.abs(F.col("p.y") - F.col("q.y")) <= most_years)).select("p.n", F.col("q.n").alias("m"))
    edges = stars("b", "s").union(stars("s", "b")).union(near).select(F.col("n").alias("a"), F.col("m").alias("b"))
    found = components(edges).withColumnRenamed("node", "n")
    labels = node.select("n").join(found, "n", "left").select("n", F.coalesce("component", "n").alias("label"))
    known = node.join(labels, "n")
    births = known.groupBy("label").agg(F.count_distinct("b").alias("births"))
    split = known.join(births, "label").withColumn("part", F.when(F.col("births") > 1, F.coalesce(F.col("b").cast("string"), F.lit("?"))).otherwise(""))
    keys = ["name", "b", "s", "a", "y"]
    r = rows.filter(evident).select("id", *[F.col(k).alias(f"__{k}") for k in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    own = r.join(split, cond[0] & cond[1] & cond[2] & cond[3] & cond[4]).select("id", "label", "part")
    named = own.withColumn("person", F.min("id").over(Window.partitionBy("label", "part"))).select(F.col("id").alias(row_id), "person")
    return named.unionByName(rows.filter(~evident).select(F.col("id").alias(row_id), F.col("id").alias("person")))


def collapsed(df: DataFrame, key: list[str], votes: str, won: str, area: str, birth: str, take: list[str]) -> DataFrame:
    """One row a key: the row of most votes (numeric take, first by it), any won, sorted distinct areas, least birth."""
    best = F.max_by(F.struct(*take), F.struct(F.col(votes), *[-F.col(c) for c in take]))
    return df.groupBy(*key).agg(best.alias("__b"), F.max(won).alias("won"), F.array_sort(F.collect_set(area)).alias("areas"), F.min(birth).alias("birth")).select(*key, "__b.*", "won", "areas", "birth")


def summaries(df: DataFrame, person: str, won: str, when: str, pos: str, party: str, most: int = 6) -> DataFrame:
    """Races, wins, losses, and the first `most` distinct parties in order of time."""
    seen = F.array_sort(F.collect_list(F.struct(when, pos, party)))
    parties = F.slice(F.array_distinct(F.transform(seen, lambda x: x[party])), 1, most)
    return df.groupBy(person).agg(F.count("*").alias("races"), F.count_if(won).alias("wins"), F.count_if(~F.col(won)).alias("losses"), parties.alias("parties"))


def lineage_edges(parties: DataFrame, name: str, successors: str, predecessors: str) -> DataFrame:
    """Distinct (source, target): successors, and predecessors turned round; both ends known."""
    a = parties.select(F.col(name).alias("source"), F.explode(successors).alias("target"))
    b = parties.select(F.explode(predecessors).alias("source"), F.col(name).alias("target"))
    known = parties.select(name)
    e = a.union(b).distinct()
    return e.join(known.withColumnRenamed(name, "source"), "source", "left_semi").join(known.withColumnRenamed(name, "target"), "target", "left_semi").select("source", "target")

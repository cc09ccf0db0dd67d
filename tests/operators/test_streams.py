"""Streams that stop and go on, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hustings.sources import paged
from hustings.streaming import scans, twins
from hustings.workers import scratch


def test_paged_stream_goes_on(spark, tmp_path):
    paged.register(spark)
    folder, path = f"file://{tmp_path}/pages", scratch(spark, "paged")
    stream = lambda: spark.readStream.format("paged_json").option("template", folder + "/{key}-{page}.json").option("keys", "a,b,none").load()
    for n in (0, 7, 7, 23):
        rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), "id", (F.col("id") * 2).alias("v"))
        paged.write_pages(rows, "k", "id", folder, 3)
        out = twins.drained(stream(), "paged", path=path).select("key", F.get_json_object("row", "$.v").cast("long").alias("v"))
        assert sorted(map(tuple, out.collect())) == sorted(("a" if i % 3 == 0 else "b", 2 * i) for i in range(n))


def test_a_batch_is_the_same_when_it_is_read_again(tmp_path, spark):
    folder = f"file://{tmp_path}"
    write = lambda n: paged.write_pages(spark.range(n).withColumn("k", F.lit("a")), "k", "id", folder, 4)
    write(10)
    reader = paged.PagedStream({"template": folder + "/{key}-{page}.json", "keys": "a"})
    assert reader.initialOffset() == {"a": None} and reader.latestOffset() == {"a": 9}
    read = lambda start, end: sorted(int(r[2].split(":")[1].split(",")[0].strip(" }")) for p in reader.partitions(start, end) for r in reader.read(p))
    assert read({"a": 3}, {"a": 9}) == [4, 5, 6, 7, 8, 9]
    write(30)
    assert read({"a": 3}, {"a": 9}) == [4, 5, 6, 7, 8, 9] and read({"a": 9}, {"a": 29}) == list(range(10, 30))
    assert reader.partitions({"a": 29}, {"a": 29}) == [] == reader.partitions({"a": None}, {"a": None})


def test_long_lists_are_read_in_parts(tmp_path, spark):
    """More than a thousand pages were an error, and a list was one task's."""
    folder = f"file://{tmp_path}"
    write = lambda n: paged.write_pages(spark.range(n).withColumn("k", F.lit("a")), "k", "id", folder, 2)
    write(2201)
    reader = paged.PagedStream({"template": folder + "/{key}-{page}.json", "keys": "a"})
    ids = lambda parts: [int(r[2].split(":")[1].split(",")[0].strip(" }")) for p in parts for r in reader.read(p)]
    parts, some = reader.partitions({"a": None}, {"a": 2200}), reader.partitions({"a": 1500}, {"a": 2200})
    assert len(parts) == 12 and len(some) == 4
    assert ids(parts) == list(range(2200, -1, -1)) and ids(some) == list(range(2200, 1500, -1))
    write(2208)  # rows move on, some over the edge of a page, after the parts were cut
    assert ids(parts) == list(range(2200, -1, -1)) and ids(some) == list(range(2200, 1500, -1))
    short = paged.PagedStream({"template": folder + "/{key}-{page}.json", "keys": "a", "most": "50"})
    with pytest.raises(ValueError):
        list(short.read(short.partitions({"a": None}, {"a": 2200})[0]))


def test_scans(spark, tmp_path):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice(["p", "q", "r"]), rng.choice("12"), start + timedelta(days=d)) for d in range(120) if rng.random() < 0.6] + [(None, "1", start), ("p", None, start)]
    want, last = set(), {}
    for k, v, t in sorted((r for r in rows if None not in r), key=lambda r: (r[2], r[1])):
        was = last.get(k)
        if was is None or was[0] != v or t > was[1] + timedelta(days=30):
            last[k] = (v, t)
            want.add((k, v, t))
    path = scratch(spark, "scans")
    schema = "doc string, file string, seen timestamp"
    for part in range(4):  # stops and goes on
        own = [r for r in rows if (r[2] - start).days // 30 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with scans.rocks(spark):
            out = twins.drained(scans.due(twins.source(spark, f"{tmp_path}/in", "*.parquet", schema), "doc", "file", "seen"), "scans", path=path)
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)

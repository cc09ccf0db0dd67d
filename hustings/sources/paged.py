"""A Python data source for paged JSON lists, read whole (one partition a key) or as a stream (a partition a hundred pages), until the total is reached.

Options: template, a path or URL with {key} and {page}; keys, comma-separated; most, pages of a key at most (an error beyond it,
never a silent end; unset: as many as the list's total needs); known, ids already there, comma-separated, of rows' field `id`, and stop: newest come first, so a key ends after
`stop` pages in a row whose rows are all known. Pages are {"total": n, "rows": [{...}]}; rows come as JSON text with their key and page. A missing first page
is an empty list.

As a stream it remembers one number a key, the newest id, however many rows there are: lists are newest first and their ids are numbers that grow. A batch is
what lies between two such marks, so it can be read again with the same result while new rows come in before it; it ends at the first
known row and never looks at older pages. Long lists, whose pages but the last have one size, are parted by
ids, not by pages, for rows move to later pages as new ones come in.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from hustings.operators.ranges import numbered
from hustings.workers import importable


#: Pages that one task of a stream reads.
SPAN = 100


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "key string, page int, row string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def _page(template: str, key: str, page: int) -> dict | None:
    """A page of a list; None if it isn't there."""
    url = template.format(key=key, page=page)
    try:
        if re.match("https?:", url):
            with urllib.request.urlopen(url, timeout=60) as f:
                return json.load(f)
        fs, path = pyarrow.fs.FileSystem.from_uri(url) if ":" in url else (pyarrow.fs.LocalFileSystem(), url)
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


class Between(InputPartition):
    """The rows of a key that came after `start` (None: all) and not after `end`, which was on this page; pages had `size` rows."""

    def __init__(self, key: str, start: int | None, end: int, page: int = 1, size: int = 0):
        self.key, self.start, self.end, self.page, self.size = key, start, end, page, size


def _limit(options) -> float:
    return int(options["most"]) if options.get("most") else float("inf")


class PagedStream(DataSourceStreamReader):
    def __init__(self, options):
        self.template, self.keys, self.most, self.id = options["template"], options["keys"].split(","), _limit(options), options.get("id", "id")

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.keys)

    def latestOffset(self) -> dict:
        first = {k: _page(self.template, k, 1) for k in self.keys}
        return {k: max((int(r[self.id]) for r in p["rows"]), default=None) if p else None for k, p in first.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [part for k, z in end.items() if z is not None and z != start.get(k) for part in self._parts(k, start.get(k), z)]

    def _parts(self, key: str, start: int | None, end: int) -> Iterator[Between]:
        """Parts from the newest rows to the oldest: one page in SPAN is looked up, and its newest id is where the next part ends."""
        first, page, upper = _page(self.template, key, 1), 1, end
        size = len(first["rows"]) if first else 0
        pages = -(-int(first["total"]) // size) if size else 1
        for at in range(1 + SPAN, int(min(pages, self.most)) + 1, SPAN):
            got = _page(self.template, key, at)
            mark = max((int(r[self.id]) for r in got["rows"]), default=None) if got else None
            if mark is None or (start is not None and mark <= start):
                break
            if mark < upper:
                yield Between(key, mark, upper, page, size)
                page, upper = at, mark
        yield Between(key, start, upper, page, size)

    def read(self, partition: Between) -> Iterator[tuple]:
        page, got = partition.page, None
        while page > 1:  # back to where all rows of the part come after, if some have gone since
            got = _page(self.template, partition.key, page)
            if got and got["rows"] and int(got["rows"][0][self.id]) > partition.end:
                break
            page -= 1
        seen = (page - 1) * partition.size
        while True:
            if page > self.most:
                raise ValueError(f"{partition.key} has more than {self.most} pages")
            got = _page(self.template, partition.key, page)
            for row in got["rows"] if got else []:
                at = int(row[self.id])
                if partition.start is not None and at <= partition.start:
                    return
                if at <= partition.end:
                    yield partition.key, page, json.dumps(row, ensure_ascii=False)
            seen += len(got["rows"]) if got else 0
            if not got or not got["rows"] or (seen >= int(got["total"]) and (partition.page == 1 or len(got["rows"]) < partition.size)):
                return
            page += 1


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.template, self.keys, self.most = options["template"], options["keys"].split(","), _limit(options)
        self.known, self.id, self.stop = {k for k in options.get("known", "").split(",") if k}, options.get("id", "id"), int(options.get("stop", "0"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.keys]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        seen, page, stale = 0, 1, 0
        while True:
            if page > self.most:
                raise ValueError(f"{partition.value} has more than {self.most} pages")
            try:
                with urllib.request.urlopen(self.template.format(key=partition.value, page=page), timeout=60) as f:
                    got = json.load(f)
            except urllib.error.URLError as e:
                if page == 1 and (getattr(e, "code", None) == 404 or isinstance(e.reason, FileNotFoundError)):
                    return
                raise
            for row in got["rows"]:
                yield partition.value, page, json.dumps(row, ensure_ascii=False)
            seen += len(got["rows"])
            stale = stale + 1 if got["rows"] and all(str(r.get(self.id)) in self.known for r in got["rows"]) else 0
            if self.stop and stale >= self.stop:
                return
            if seen >= int(got["total"]) or not got["rows"]:
                return
            page += 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def write_pages(rows: DataFrame, key: str, id_col: str, folder: str, size: int = 100) -> None:
    """Lists as files {folder}/{key}-{page}.json of at most `size` rows, newest id first; what `paged_json` reads."""
    importable(rows.sparkSession)
    placed = numbered(rows.select(F.col(key).cast("string").alias("key"), F.col(id_col).alias("id"), F.struct("*").alias("row")), [F.col("key"), F.col("id").desc()], "place")
    first = placed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("total"))
    paged = placed.join(first, "key").withColumn("page", (F.floor((F.col("place") - F.col("first")) / size) + 1).cast("int"))
    pages = paged.groupBy("key", "page", "total").agg(F.to_json(F.struct(F.first("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("rows"))).alias("json"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for k, page, text in zip(*(b.column(c).to_pylist() for c in ("key", "page", "json")), strict=True):
                with fs.open_output_stream(f"{base}/{k}-{page}.json") as f:
                    f.write(text.encode())
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    pages.select("key", "page", "json").mapInArrow(write, "n long").agg(F.sum("n")).collect()

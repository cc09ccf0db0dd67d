"""Readers. Schemas are given, never inferred; bad values become null, bad records are kept apart or left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_by_key(spark: SparkSession, path: str, schema: str, key: str, sep: str = ",") -> DataFrame:
    """Rows of a CSV file or folder; of rows with one key the last (by file and place in it) stays."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path).withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("__file").desc(), F.col("__at").desc()))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "__file", "__at")


def first_of(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Union of CSV files; each key keeps its row of the first path that has it."""
    parts = [spark.read.schema(schema).option("header", True).csv(p).withColumn("__prio", F.lit(i)) for i, p in enumerate(paths)]
    every = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__prio", *[c for c in every.columns if c != "__prio"]))
    return every.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "__prio")


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents with their file, files of broken ones) of a folder of JSON files, a document each."""
    shape = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = whole.withColumn("__fine", F.try_parse_json("value").isNotNull())
    return rows.filter("__fine").select("file", F.from_json("value", shape).alias("d")).select("file", "d.*"), rows.filter("NOT __fine").select("file")


def chunks(spark: SparkSession, path: str, schema: str | T.StructType, parts: list[str] | None = None) -> DataFrame:
    """A table written by sinks.split: all of its parts, or those named, which prunes folders."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if parts is None else rows.filter(F.col("chunk").isin(parts))


def tsv(spark: SparkSession, path: str, names: dict[str, str], numbers: list[str]) -> DataFrame:
    """names: output -> header of the file. Numbers lose their thousands commas; what isn't one is null."""
    raw = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    return raw.select(*[(F.regexp_replace(F.col(f"`{h}`"), ",", "").try_cast("double") if o in numbers else F.col(f"`{h}`")).alias(o) for o, h in names.items()])


def encodings(spark: SparkSession, path: str, fallback: str = "ISO-8859-1", others: tuple[str, ...] = ("cp949",)) -> DataFrame:
    """(file, encoding) of each file of a path, by its whole content, line by line in tasks: a mark at its start (UTF-16), UTF-8 if all lines are, else the
    first of `others` (Python's names) in which all lines can be read, else the fallback."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    wide = F.substring(F.hex("raw"), 1, 4).isin("FFFE", "FEFF")
    kinds = lines.groupBy("file").agg(F.max(wide).alias("wide"), F.min(F.expr("is_valid_utf8(cast(raw as string))")).alias("utf8"))

    @F.pandas_udf("array<string>")
    def readable(raw):
        def fits(b: bytes, kind: str) -> bool:
            try:
                b.decode(kind)
            except UnicodeDecodeError:
                return False
            return True

        return raw.map(lambda b: [k for k in others if fits(bytes(b), k)])

    unclear = kinds.filter("NOT wide AND NOT utf8").select("file")
    tried = lines.join(unclear, "file").select("file", readable("raw").alias("fits"))
    able = tried.groupBy("file").agg(*[F.min(F.array_contains("fits", k)).alias(f"__{i}") for i, k in enumerate(others)]) if others else unclear
    other = F.coalesce(*[F.when(F.col(f"__{i}"), F.lit(k)) for i, k in enumerate(others)], F.lit(fallback))
    return kinds.join(able, "file", "left").select("file", F.when(F.col("wide"), "UTF-16").when(F.col("utf8"), "UTF-8").otherwise(other).alias("encoding"))


#: What Spark's CSV reader can read itself.
SPARK_SETS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")


def encoded_csv(spark: SparkSession, path: str, schema: str, fallback: str = "ISO-8859-1", others: tuple[str, ...] = ("cp949",)) -> DataFrame:
    """A CSV file or folder, each file in its own character set; rows come without their file's order. The first line of a file is its header; in sets that
    Spark doesn't know, lines that spell the schema's names are headers."""
    shape = T._parse_datatype_string(schema)
    files: dict[str, list[str]] = {}
    for r in encodings(spark, path, fallback, others).collect():  # a row a file, as a listing has
        files.setdefault(r["encoding"], []).append(r["file"])
    parts = [spark.createDataFrame([], shape)]
    for kind, names in sorted(files.items()):
        if kind in SPARK_SETS:
            wide = kind.startswith(("UTF-16", "UTF-32"))  # a line's end isn't one byte: such files are read whole
            parts.append(spark.read.schema(shape).option("header", True).option("encoding", kind).option("multiLine", wide).csv(names))
            continue

        @F.pandas_udf("string")
        def decoded(raw, kind=kind):
            return raw.map(lambda b: bytes(b).decode(kind).rstrip("\r"))

        plain = T.StructType([T.StructField(f.name, T.StringType()) for f in shape])
        text = spark.read.text(names).select(decoded(F.col("value").cast("binary")).alias("line")).filter("line <> ''")
        rows = text.select(F.from_csv("line", ", ".join(f"`{f.name}` string" for f in plain)).alias("s"), F.from_csv("line", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)).alias("r"))
        is_header = reduce(lambda a, b: a & b, [F.coalesce(F.lower(F.trim(F.col("s").getField(f.name))) == f.name.lower(), F.lit(False)) for f in plain])
        parts.append(rows.filter(~is_header).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def unpivot(df: DataFrame, meta: list[str], name: str = "option", value: str = "votes") -> DataFrame:
    """Every column outside meta is an option; null and blank values are left out, commas removed."""
    wide = df.select(*meta, *[F.regexp_replace(F.col(f"`{c}`").cast("string"), ",", "").try_cast("double").alias(c) for c in df.columns if c not in meta])
    return wide.unpivot(meta, [c for c in wide.columns if c not in meta], name, value).filter(F.col(value).isNotNull())


def numbered(df: DataFrame, keep: list[str], groups: dict[str, str], most: int) -> DataFrame:
    """Numbered columns to rows: groups gives output -> prefix of columns prefix01..; rows without a first group's value are left out; pos from 1."""
    items = [F.struct(F.lit(i).alias("pos"), *[F.col(f"{prefix}{i:02d}").alias(out) for out, prefix in groups.items()]) for i in range(1, most + 1) if f"{next(iter(groups.values()))}{i:02d}" in df.columns]
    first = next(iter(groups))
    return df.select(*keep, F.inline(F.array(*items))).filter(F.coalesce(F.col(first).cast("string"), F.lit("")) != "")


def attributes(df: DataFrame, by: list[str], name: str, value: str, metrics: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A column that holds metric labels and options: (metrics by group as columns, rows of options)."""
    wide = df.groupBy(*by).agg(*[F.sum(F.when(F.col(name) == label, F.col(value))).alias(out) for out, label in metrics.items()])
    return wide, df.filter(~F.col(name).isin(list(metrics.values())))


def totals_or_parts(df: DataFrame, unit: str, totals: list[str], by: list[str], value: str) -> DataFrame:
    """Sums by group: where the table has any total row, of total rows alone, else of all rows."""
    is_total = F.coalesce(F.col(unit).isin(totals), F.lit(False))  # a null unit is a part
    some = df.filter(is_total).agg((F.count("*") > 0).alias("__some"))
    return df.join(F.broadcast(some)).filter(is_total == F.col("__some")).groupBy(*by).agg(F.sum(value).alias(value))


def filled_down(df: DataFrame, order: list[str], state: str, by: list[str]) -> DataFrame:
    """A spreadsheet's merged or heading cells: the last value of `state` above each row of its sheet."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(state, F.last(F.nullif(F.col(state), F.lit("")), ignorenulls=True).over(w))


def paired_rows(df: DataFrame, group: list[str], order: str, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Two rows a group, names above values: (group, pos, names[0], names[1]) for each column with both."""
    w = Window.partitionBy(*group).orderBy(order)
    cells = df.withColumn("__k", F.row_number().over(w)).select(*group, "__k", F.posexplode(F.array(*columns)).alias("pos", "v"))
    two = cells.groupBy(*group, "pos").agg(F.max(F.when(F.col("__k") == 1, F.col("v"))).alias(names[0]), F.max(F.when(F.col("__k") == 2, F.col("v"))).alias(names[1]))
    return two.filter(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())


def present(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Union of those JSON files that are there; none: an empty table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def xml_rows(df: DataFrame, payload: str, schema: str, rows: str) -> DataFrame:
    """Rows of an XML payload column; payloads that aren't XML have none."""
    return df.withColumn("__x", F.from_xml(payload, schema)).select(*df.columns, F.inline(f"__x.{rows}"))


def wiki_cells(df: DataFrame, markup: str) -> DataFrame:
    """Cells of the rows of wiki tables: lines that begin with a bar, cells parted by two; links keep their text."""
    line = F.explode(F.regexp_extract_all(F.col(markup), F.lit(r"(?m)^\|(?![-}+])(.*)$"), F.lit(1)))
    plain = F.regexp_replace(F.col("__line"), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return df.select(*[c for c in df.columns if c != markup], line.alias("__line")).withColumn("cells", F.transform(F.split(plain, r"\|\|"), lambda c: F.trim(c))).drop("__line")


def solutions(bindings: DataFrame, solution: str, variable: str, value: str, variables: list[str]) -> DataFrame:
    """SPARQL bindings (solution, variable, value) as rows with a column for each variable."""
    return bindings.groupBy(solution).pivot(variable, variables).agg(F.first(value))


def catalogue(spark: SparkSession, path: str, rules: list[tuple[str, str]], checksum: bool = False) -> DataFrame:
    """(path, kind, bytes, modified[, sha256]) of files: the kind of the first pattern that the path matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.coalesce(*[F.when(F.col("path").rlike(p), k) for p, k in rules], F.lit("other"))
    return files.select("path", kind.alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if checksum else []))


def catalogue_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def best_file(files: DataFrame, key: str, name: str, order: list[str], never: str) -> DataFrame:
    """One file a key: by the first pattern of `order` that its name matches, then any whose name doesn't match `never`."""
    place = F.coalesce(*[F.when(F.col(name).rlike(p), F.lit(i)) for i, p in enumerate(order)], F.when(~F.col(name).rlike(never), F.lit(len(order))))
    return files.withColumn("__p", place).filter("__p IS NOT NULL").groupBy(key).agg(F.min_by(name, F.struct("__p", name)).alias(name))


def page_list(total: Column, size: int) -> Column:
    """Page numbers, from 1, of a list of `total` rows."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(total / size).cast("int")))

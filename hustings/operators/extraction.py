"""Out of words and cells of a page: titles, total rows, anchors, names above numbers, table rows, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.operators.turns import in_turn
from hustings.workers import temporary, written


def first_match(text: Column, patterns: list[str], fallback: Column | None = None) -> Column:
    """Group 1 of the first pattern that is found and isn't empty, trimmed; else the fallback."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found, *([fallback] if fallback is not None else []))


def total_line(lines: DataFrame, page: list[str], line: str, text: str, marker: str, word: str, least: int = 4) -> DataFrame:
    """One line a page: the first that holds the marker, else the first that begins with the word and has `least` numbers."""
    numbers = F.size(F.regexp_extract_all(F.col(text), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    kind = F.when(F.contains(text_ := F.col(text), F.lit(marker)), 0).when(F.startswith(F.ltrim(text_), F.lit(word)) & (numbers >= least), 1)
    w = Window.partitionBy(*page).orderBy("__kind", line)
    return lines.withColumn("__kind", kind).filter("__kind IS NOT NULL").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__kind")


def column_values(text: Column, whole: float = 100.0, within: float = 0.5) -> Column:
    """The numbers of a total row: without case counts in parentheses, and without a last one that is the whole itself."""
    plain = F.regexp_replace(text, r"\([^)]*\)", " ")
    v = F.transform(F.regexp_extract_all(plain, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    closes = F.abs(F.element_at(v, -1) - whole) <= within
    return F.when(F.size(v) == 0, v).when(closes, F.slice(v, 1, F.size(v) - 1)).otherwise(v)


def data_row(cells: Column, share: float = 0.6) -> Column:
    """Whether at least `share` of the filled cells are numbers."""
    filled = F.filter(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    numeric = F.filter(filled, lambda c: F.regexp_replace(c, r"[,%\s]", "").rlike(r"^\(?[0-9]+(\.[0-9]+)?\)?$"))
    return (F.size(filled) > 0) & (F.size(numeric) >= share * F.size(filled))


def header(rows: DataFrame, table: list[str], row: str, cells: str) -> DataFrame:
    """One array a table: the cells above its first data row, joined by column; distinct texts only."""
    w = Window.partitionBy(*table).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    above = rows.withColumn("__seen", F.max(data_row(F.col(cells)).cast("int")).over(w)).filter("__seen = 0")
    c = above.select(*table, row, F.posexplode(cells).alias("__at", "__c")).filter("trim(coalesce(__c, '')) <> ''")
    g = c.groupBy(*table, "__at").agg(F.array_sort(F.collect_list(F.struct(row, F.trim("__c").alias("c")))).alias("__x"))
    g = g.select(*table, "__at", F.array_join(F.array_distinct(F.transform("__x", lambda x: x["c"])), " ").alias("__t"))
    return g.groupBy(*table).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__t"))), lambda x: F.struct(x["__at"].alias("column"), x["__t"].alias("text"))).alias("header"))


def paired_header(
    lines: DataFrame, page: list[str], line: str, text: str, parties: list[str], least: int = 2, window: int = 3, below: int = 7,
    name: str = r"\p{L}{2,4}", words: list[str] = [], data: str = r"^\s*[0-9(]", body: str | None = None,  # noqa: B006
) -> DataFrame:
    """(page, pos, party, name): parties of the first `window` lines that together hold `least` distinct ones, paired with names from the lines after the
    first of them.

    A party within a longer one that is there doesn't count; longer parties come first, equally long ones as listed. Lines that together hold the
    pattern `body` end the search for parties. Names are matches of `name` in up to `below` lines, up to one that holds the pattern `data`, in order of
    reading, but for parties, beginnings and ends of parties, and `words` of headers. The shorter of the two lists settles how many pairs
    there are. Null texts are empty.
    """
    w = Window.partitionBy(*page).orderBy(line)
    t = F.coalesce(F.col(text), F.lit(""))
    ranked = sorted(dict.fromkeys(parties), key=lambda p: -len(p))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    near = F.array_join(F.collect_list(t).over(w.rowsBetween(0, window - 1)), " ")
    found = lines.withColumn("__near", near).withColumn("__after", F.collect_list(t).over(w.rowsBetween(1, below)))
    found = found.withColumn("__data", F.col("__near").rlike(body).cast("int") if body is not None else F.lit(0))
    found = found.withColumn("__seen", F.max("__data").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hits = F.filter(strings(ranked), lambda p: F.contains(F.col("__near"), p))
    alone = F.filter(hits, lambda p: ~F.exists(hits, lambda q: (q != p) & F.contains(q, p)))
    found = found.withColumn("__p", alone).filter((F.size("__p") >= least) & (F.col("__seen") == 0))
    first = found.groupBy(*page).agg(F.min_by(F.struct("__p", "__after"), line).alias("h")).select(*page, "h.*")
    stops = F.filter(F.transform("__after", lambda x, i: F.when(x.rlike(data), i)), lambda i: i.isNotNull())
    heads = F.slice("__after", F.lit(1), F.coalesce(F.array_min(stops), F.size("__after")))
    tokens = F.flatten(F.transform(heads, lambda x: F.regexp_extract_all(x, F.lit(f"({name})"), F.lit(1))))
    part = lambda x: F.exists(strings(ranked), lambda p: p.startswith(x) | p.endswith(x))
    names = F.filter(tokens, lambda x: ~x.isin(words) & ~part(x)) if words else F.filter(tokens, lambda x: ~part(x))
    both = first.withColumn("__n", names).withColumn("__k", F.least(F.size("__p"), F.size("__n")))
    zipped = F.arrays_zip(F.slice("__p", F.lit(1), F.col("__k")).alias("party"), F.slice("__n", F.lit(1), F.col("__k")).alias("name"))
    return both.select(*page, F.posexplode(zipped).alias("pos", "z")).select(*page, "pos", "z.party", "z.name")


def names_above(words: DataFrame, anchors: DataFrame, page: list[str], x: str, y: str, text: str, anchor: str, within: float) -> DataFrame:
    """(page, anchor, text): for each anchor from left to right the topmost word within `within` that no anchor took before. Repeated anchors take one each."""
    with temporary(words.sparkSession) as keep:
        a = written(anchors.select(*page, F.col(anchor).cast("double").alias("at")).withColumn("agent", F.monotonically_increasing_id()), "anchors")
        w = words.select(*page, F.col(x).alias("x"), F.col(y).alias("y"), F.col(text).alias("item"))
        near = a.join(w, page).filter(F.abs(F.col("x") - F.col("at")) <= within)
        place = near.groupBy(*page, "agent", "at", "item").agg(F.min(F.struct("y", "x")).alias("place"))
        taken = in_turn(place.withColumn("rank", F.struct("at", "agent")), page, "agent", "rank", "item", "place")
        return keep(written(taken.join(a.select("agent", "at"), "agent").select(*page, F.col("at").alias(anchor), F.col("item").alias(text)), "names-above"))


def clusters(values: DataFrame, group: list[str], x: str, pos: str, within: float) -> DataFrame:
    """Adds cluster: values in order of pos join the first cluster whose running mean is within `within`. Sequential within a group."""
    import pandas as pd
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*values.schema.fields]).add("cluster", LongType())

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        means: list[float] = []
        sizes: list[int] = []
        own = []
        for v in pdf[x]:
            k = next((i for i, m in enumerate(means) if abs(m - v) <= within), len(means))
            if k == len(means):
                means.append(float(v))
                sizes.append(1)
            else:
                sizes[k] += 1
                means[k] += (v - means[k]) / sizes[k]
            own.append(k)
        return pdf.assign(cluster=own)

    return values.groupBy(*group).applyInPandas(fit, schema)


def without_leak(name: Column, prefix: str, surnames: list[str]) -> Column:
    """A name that is the prefix, a surname and one or two letters loses the prefix."""
    return F.coalesce(F.nullif(F.regexp_extract(name, rf"^{prefix}((?:{'|'.join(surnames)})\p{{L}}{{1,2}})$", 1), F.lit("")), name)


def preferred_rows(stored: DataFrame, other: DataFrame, key: list[str], clean: Column, pos: str) -> DataFrame:
    """Per key the rows of `other` if all of them are clean and they are not fewer, else the stored ones."""
    o = other.groupBy(*key).agg(F.count("*").alias("__n"), F.min(clean.cast("int")).alias("__clean"))
    s = stored.groupBy(*key).agg(F.count("*").alias("__m"))
    better = s.join(o, key).filter("__clean = 1 AND __n >= __m").select(*key)
    return stored.join(better, key, "left_anti").unionByName(other.join(better, key, "left_semi").select(*stored.columns))


def overlaid(stored: DataFrame, new: DataFrame, poll: list[str], question: str, garbage: Column) -> DataFrame:
    """Polls of `new` get its questions; their other stored questions stay only if they aren't garbage and have fewer than two candidates (n)."""
    mine = new.select(*poll).distinct().withColumn("__new", F.lit(True))
    j = stored.join(new.select(*poll, question).distinct(), [*poll, question], "left_anti").join(mine, poll, "left")
    return j.filter(F.col("__new").isNull() | (~garbage & (F.col("n") < 2))).select(*stored.columns).unionByName(new.select(*stored.columns))


def repaired_glyphs(text: Column, glyphs: dict[str, str], common: list[str]) -> Column:
    """Mapped characters, where the text has a Hangul syllable but no common word; only mappings to a Hangul syllable count."""
    fine = {k: v for k, v in sorted(glyphs.items()) if len(k) == len(v) == 1 and "가" <= v <= "힣"}
    known = F.lit(False)
    for w in common:
        known = known | F.contains(text, F.lit(w))
    return F.when(text.rlike("[가-힣]") & ~known, F.translate(text, "".join(fine), "".join(fine.values()))).otherwise(text)

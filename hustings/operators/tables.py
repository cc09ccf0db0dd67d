"""Tables of cells found on pages: merged headings, what a table is about, and the options with their shares.

Words are the caller's: parties, words that no name is, titles that make a table something else. A table is one row here, as it is one thing on a page.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Words:
    """What the tables' language is: patterns are Java's, the rest plain text. Parties count longest first."""

    parties: tuple[str, ...]
    name: str  # one name, without anchors
    total: str = r"^total$"  # a whole cell
    metric: tuple[str, ...] = ()  # in titles, blanks left out: tables of something else
    party_title: str = ""  # in titles, blanks left out: tables of parties
    offices: tuple[str, ...] = ()  # in longer cells that begin with a name
    no_names: tuple[str, ...] = ()
    no_columns: tuple[str, ...] = ()  # in headings of columns that are no option
    answers: tuple[str, ...] = ()  # the same, unless a party is in them, too
    short: int = 6
    ranked: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "ranked", tuple(sorted(dict.fromkeys(self.parties), key=lambda p: -len(p))))


#: A number or share, maybe in parentheses.
NUMBER = r"^\(?[0-9]+([.,][0-9]+)?%?\)?$"


def whole(rows: DataFrame, table: list[str], row: str, cells: str) -> DataFrame:
    """(table, rows): one row a table, its rows in order, cells trimmed, nulls empty."""
    clean = F.transform(F.coalesce(F.col(cells), F.array().cast("array<string>")), lambda c: F.trim(F.coalesce(c, F.lit(""))))
    g = rows.groupBy(*table).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("at"), clean.alias("c")))).alias("__r"))
    return g.select(*table, F.transform("__r", lambda x: x["c"]).alias("rows"))


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: c != "")


def _is_data(cells: Column) -> Column:
    """Three cells or more are filled, and of these two and 60 % are numbers or shares."""
    n = F.size(_filled(cells))
    return (n >= 3) & (F.size(F.filter(cells, lambda c: c.rlike(NUMBER))) >= F.greatest(F.lit(2), F.floor(n * 0.6)))


def _is_title(cells: Column) -> Column:
    """One cell alone is filled, or few are and one is long: what stands over a table."""
    n, longest = F.size(_filled(cells)), F.array_max(F.transform(cells, lambda c: F.length(c)))
    return ((n == 1) & (F.size(cells) >= 3)) | ((longest > 10) & (n <= F.greatest(F.lit(2), F.floor(F.size(cells) / 3))))


def _first(rows: Column, test) -> Column:
    """The place, from 0, of the first row that passes; null if none does."""
    return F.array_min(F.filter(F.transform(rows, lambda r, i: F.when(test(r), i)), lambda i: i.isNotNull()))


def headed(tables: DataFrame, words: Words) -> DataFrame:
    """Adds header (a text a column: the cells above the data, joined downwards, without titles) and data (the row of totals, else the first of the data)."""
    is_total = lambda r: F.exists(r, lambda c: c.rlike(words.total))
    out = tables.withColumn("__at", F.coalesce(_first(F.col("rows"), is_total), _first(F.col("rows"), _is_data), F.lit(0)))
    out = out.withColumn("__head", F.when(F.col("__at") == 0, F.slice("rows", 1, 1)).otherwise(F.filter(F.slice("rows", F.lit(1), F.col("__at")), lambda r: ~_is_title(r))))
    width = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    column = lambda k: F.array_join(F.transform("__head", lambda r: F.coalesce(F.get(r, k), F.lit(""))), "")
    out = out.withColumn("header", F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), column)).otherwise(F.array().cast("array<string>")))
    start = F.greatest(F.col("__at"), F.lit(1))
    rest = F.slice("rows", start + 1, F.greatest(F.size("rows") - start, F.lit(0)))
    return out.withColumn("data", F.get(rest, F.coalesce(_first(rest, is_total), F.lit(0)))).drop("__at", "__head")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _without(text: Column, words: tuple[str, ...]) -> Column:
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(""))
    return text


def kind(title: Column, header: Column, words: Words) -> Column:
    """What a table is: metric (by its title), party, candidate (a heading is a name, or a longer one begins with one and tells an office), or skip."""
    about = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", "")
    parties = F.size(F.filter(header, lambda h: _any(h, words.ranked)))
    bare = lambda h: _without(h, words.ranked)
    named = lambda h: F.when(F.length(bare(h)) <= words.short, F.regexp_extract(bare(h), f"^({words.name})$", 1)).otherwise(F.when(_any(bare(h), words.offices), F.regexp_extract(bare(h), f"^({words.name})", 1)).otherwise(""))
    is_name = lambda h: (named(h) != "") & ~named(h).isin(*words.no_names, "")
    by_title = F.contains(about, F.lit(words.party_title)) & (parties >= 3) if words.party_title else F.lit(False)
    return F.when(_any(about, words.metric), "metric").when(by_title, "party").when(F.exists(header, is_name), "candidate").when(parties > 0, "party").otherwise("skip")


def options(tables: DataFrame, table: list[str], words: Words, title: str) -> DataFrame:
    """(table, kind, place, party, name, share) of tables with header and data: a row for each column that is an option.

    Its share is the first number of the data cell, from 0 to 100. Its party is the longest that its heading holds. Of a table of candidates, the name
    stands right before the party, else after it, else first; columns without a name are left out. Parties' tables have no names.
    """
    out = tables.withColumn("kind", kind(F.col(title), F.col("header"), words)).filter(F.col("kind").isin("candidate", "party"))
    c = out.select(*table, "kind", "data", F.posexplode("header").alias("place", "h"))
    party = F.coalesce(*[F.when(F.contains("h", F.lit(p)), F.lit(p)) for p in words.ranked], F.lit(""))
    skip = (F.col("h") == "") | _any(F.col("h"), words.no_columns) | ((F.col("party") == "") & _any(F.col("h"), words.answers))
    share = F.nullif(F.regexp_extract(F.coalesce(F.get("data", F.col("place")), F.lit("")), r"([0-9]{1,3}(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    found = lambda text: F.filter(F.regexp_extract_all(text, F.lit(f"({words.name})"), F.lit(1)), lambda x: ~x.isin(*words.no_names, ""))
    before = F.expr("substring_index(h, party, 1)")
    after = F.substr("h", F.length(before) + F.length("party") + 1)
    name = F.when(F.col("party") == "", F.get(found(F.col("h")), F.lit(0))).otherwise(F.coalesce(F.try_element_at(found(before), F.lit(-1)), F.get(found(after), F.lit(0))))
    c = c.withColumn("party", party).filter(~skip).withColumn("share", share).withColumn("name", F.when(F.col("kind") == "candidate", name).otherwise(""))
    return c.filter(F.col("share").between(0, 100) & F.col("name").isNotNull()).select(*table, "kind", "place", "party", "name", "share")

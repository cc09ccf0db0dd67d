"""Text helpers: falsy-aware choices, parses of shares, ranges, regions, districts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"\s+", "")


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def number(text: Column) -> Column:
    """A double out of text with thousands commas and per cent signs; null if it is none."""
    return F.regexp_replace(text, r"[,%\s]", "").try_cast("double")


def integer_or_zero(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[,\s]", "").try_cast("long"), F.lit(0))


def range_bounds(text: Column) -> Column:
    """struct<low, high> of "178~196"; a single number is both; null if there is none."""
    low = F.regexp_extract(text, r"([0-9]+)", 1).try_cast("int")
    high = F.regexp_extract(text, r"[0-9]+\s*[~-]\s*([0-9]+)", 1).try_cast("int")
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.coalesce(high, low).alias("high")))


def margin_of_error(text: Column) -> Column:
    """The number after a plus-minus sign."""
    return F.regexp_extract(text, r"±\s*([0-9.]+)", 1).try_cast("double")


def region_parts(text: Column) -> Column:
    """struct<region, unit, rest>: first word, second word with its ending, what follows."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.struct(F.get(words, F.lit(0)).alias("region"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("unit"), F.array_join(F.slice(words, 3, F.size(words)), " ").alias("rest"))


def stem(text: Column, suffixes: list[str]) -> Column:
    """Without the first of the suffixes that it ends in; never emptied."""
    out = text
    for s in reversed(suffixes):
        out = F.when(F.endswith(text, F.lit(s)) & (F.length(text) > len(s)), F.left(text, F.length(text) - len(s))).otherwise(out)
    return out


def district_parts(name: Column, source: Column, markers: list[str], suffixes: list[str], parted: str = "·") -> Column:
    """struct<parts, marker> of a compound district: its units without suffixes, and the marker at its end (else in the source's name, else empty)."""
    either = "|".join(markers)
    bare = F.regexp_replace(F.trim(name), rf"\s*(?:{either})$", "")
    marker = F.coalesce(F.nullif(F.regexp_extract(F.trim(name), rf"({either})$", 1), F.lit("")), F.regexp_extract(source, rf"({either})", 1))
    return F.struct(F.transform(F.split(bare, parted), lambda p: stem(F.trim(p), suffixes)).alias("parts"), F.coalesce(marker, F.lit("")).alias("marker"))


def round_label(identifier: Column, kinds: dict[str, str]) -> Column:
    """"9th-local-2026" -> "9 local": number and label of the kind."""
    n, kind = F.regexp_extract(identifier, r"^([0-9]+)(?:st|nd|rd|th)-", 1), F.regexp_extract(identifier, r"^[0-9]+[a-z]+-([a-z]+)", 1)
    label = F.create_map(*[F.lit(x) for pair in sorted(kinds.items()) for x in pair])
    return F.when(n != "", F.concat(n, F.lit(" "), F.coalesce(F.element_at(label, kind), kind)))


def zipped_careers(terms: Column, parties: Column, districts: Column) -> Column:
    """array<struct<term, party, district>>: comma-separated terms with slash-separated parties and districts, whose last value repeats."""
    t, p, d = F.split(terms, r"\s*,\s*"), F.split(parties, "/"), F.split(districts, "/")
    at = lambda a, i: F.coalesce(F.get(a, i), F.element_at(a, -1))
    return F.transform(t, lambda x, i: F.struct(x.alias("term"), at(p, i).alias("party"), at(d, i).alias("district")))


def aggregate_or_sum(values: Column, tolerance: float = 1.2) -> Column:
    """A value that equals the sum of the others within the tolerance (the first of them), else the sum of all."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    own = F.filter(values, lambda v: F.abs(2 * v - total) < tolerance)
    return F.when((F.size(values) > 1) & (F.size(own) > 0), F.get(own, F.lit(0))).otherwise(total)


def valid_answer(positive: Column, negative: Column, unknown: Column) -> Column:
    """With a share of undecided: all add to 97..103; without: positive and negative to 80..100."""
    return F.when(unknown.isNotNull(), (positive + negative + unknown).between(97, 103)).otherwise((positive + negative).between(80, 100))


def noise_name(name: Column, words: list[str], endings: list[str], starts: list[str] = [], holds: list[str] = [], patterns: list[str] = [], longer: list[str] = []) -> Column:  # noqa: B006
    """Whether a token isn't a name: not 2 to 4 letters (null included), a listed word, with a listed start or ending, holding a listed part
    anywhere, matching a pattern, or holding a part of `longer` and more letters than that part.

    The lists are the caller's vocabulary; as all rules are or-ed, their order doesn't matter. Lists of texts become one alternation each.
    """
    quoted = lambda parts: "|".join(rf"\Q{p}\E" for p in parts)
    whole = [rf"^(?:{quoted(starts)})"] * bool(starts) + [f"(?:{quoted(holds)})"] * bool(holds) + [f"(?:{quoted(endings)})$"] * bool(endings)
    found = ~F.coalesce(name.rlike(r"^\p{L}{2,4}$"), F.lit(False)) | name.isin(words)
    for rule in whole + patterns + [rf"(?:.{p}|{p}.)" for p in map(lambda x: rf"\Q{x}\E", longer)]:
        found = found | name.rlike(rule)
    return found


def fused(token: Column, parties: list[str]) -> Column:
    """struct<name, party> of a token of 5 letters or more that ends or begins with a party (longest first), its stem 2 to 4 letters."""
    out = F.lit(None).cast("struct<name:string,party:string>")
    for p in sorted(parties, key=lambda x: (len(x), x)):
        n = F.length(token) - len(p)
        fits = (F.length(token) >= 5) & n.between(2, 4)
        out = F.when(fits & F.startswith(token, F.lit(p)), F.struct(F.right(token, n).alias("name"), F.lit(p).alias("party"))).otherwise(out)
        out = F.when(fits & F.endswith(token, F.lit(p)), F.struct(F.left(token, n).alias("name"), F.lit(p).alias("party"))).otherwise(out)
    return out

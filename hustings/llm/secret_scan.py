"""Secret scans in DataFrame functions only.

Base kinds are patterns. The entropy kind looks at candidate strings: runs of token characters in the text from which base
matches have been blanked, kind after kind (what is left on either side of a base match is a candidate of its own). A window
slides over each candidate; the counts of the symbols of the candidate's character class, packed into a few whole numbers, are
kept up to date as one symbol enters and one leaves, and the Shannon entropy of the window follows from the running sum of
c * log2(c). A candidate whose best window reaches the threshold of its class is a span, unless the allow-list explains it.

All work is linear in the text: places come from running sums over what lies between matches, symbols are looked up once, and
no pattern repeats a group. Running values are computed in stretches of BLOCK, so that arrays are not copied for each step.

Positions are in code points, end exclusive. Null text counts as empty: no spans. Texts of any length are scanned whole;
equal rows give equal results; an empty table gives an empty one. Extra columns don't matter, save that `scan` replaces
columns of its own names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.batches import quoted
from hustings.llm.higher_order import let, running

#: The base patterns, and the least length of what they must hold (assign: of group 2).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

#: Rows that hold none of these have no base span; cheap to test before positions are computed.
MAY_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
MAY_ACCESS = r"AKIA[A-Z0-9]{14}"
MAY_HEX = r"[0-9a-f]{16}"

#: Candidate strings of the entropy kind, the window, and the least bits per symbol by class.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=.-]{20,}"
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.2),
    "alnum": (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.7),
    "base64": (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-", 3.8),
}
#: What looks random and is none: no digit at all, digits and marks only, UUIDs.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[0-9+/_=.-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: And, cut at marks: paths and host names of words and short numbers; versions and dates, which begin with a number.
MARKS, WORDS = r"[./_=-]+", r"^([A-Za-z]*|[0-9]{1,4})$"
POINTS, NUMBER, SHORT = r"[._-]", r"^v?[0-9]+$", r"^[A-Za-z0-9]{1,8}$"

#: Counters in a whole number, and units of a bit in exact sums of c * log2(c).
PACKED, UNIT = 12, 1 << 40


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<before, hit>> of the leftmost non-overlapping matches, each with what lies before it; last, what is left and no hit."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, h: F.struct(b.alias("before"), h.alias("hit")))


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches: lengths of what lies between them give places."""

    def places(found: Column) -> Column:
        ends = running(found, F.lit(0), lambda at, x: at + F.length(x["before"]) + F.length(x["hit"]))
        return F.zip_with(found, ends, lambda x, e: F.struct((e - F.length(x["hit"])).alias("start"), e.alias("end"), x["hit"].alias("hit")))

    return let(F.filter(_matches(text, pattern), lambda x: x["hit"].isNotNull()), places)


def _blanked(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """The text with its kept matches as blanks, as long as before."""
    blank = lambda h: F.when(keep(h), F.repeat(F.lit(" "), F.length(h))).otherwise(h)
    return F.array_join(F.transform(_matches(text, pattern), lambda x: F.concat(x["before"], F.coalesce(blank(x["hit"]), F.lit("")))), "")


def _spans(kind: str, located: Column, keep: Callable[[Column], Column]) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(F.filter(located, lambda x: keep(x["hit"])), lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end")))


def least_sum(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The least sum of c * log2(c), in UNITs, of any window over s; c counts a symbol, those outside the alphabet share one counter."""
    weight = F.array(*[F.lit(round(k * math.log2(k) * UNIT) if k else 0) for k in range(window + 2)])
    counters = F.array_repeat(F.lit(0).cast("long"), len(alphabet) // PACKED + 1)
    number = lambda k: F.struct(F.floor(k / PACKED).cast("int").alias("word"), (k % PACKED * 5).alias("shift"))
    count = lambda n, k: F.call_function("shiftright", F.get(n, k["word"]), k["shift"]).bitwiseAND(F.lit(31)).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k["shift"])

    def step(a: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        moved = F.transform(a["n"], lambda c, j: c + F.when(j == enters["word"], one(enters)).otherwise(0) - F.when(j == leaves["word"], one(leaves)).otherwise(0))
        was, gone = count(a["n"], enters), count(a["n"], leaves)
        grown = F.get(weight, was + 1) - F.get(weight, was)
        shrunk = F.coalesce(F.get(weight, gone) - F.get(weight, gone - 1), F.lit(0).cast("long"))
        total = F.when(enters == leaves, a["sum"]).otherwise(a["sum"] + grown - shrunk)
        return let(total, lambda now: F.struct(
            moved.alias("n"), now.alias("sum"), (a["seen"] + 1).alias("seen"), F.when(a["seen"] + 1 >= window, F.least(a["least"], now)).otherwise(a["least"]).alias("least")
        ))

    def slid(symbols: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(None).cast("struct<word:int,shift:int>"), window), F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - window, F.lit(0))))
        moves = F.zip_with(symbols, F.slice(gone, F.lit(1), F.size(symbols)), lambda e, l: F.struct(e.alias("enters"), l.alias("leaves")))
        start = F.struct(counters.alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("seen"), F.lit((1 << 62)).cast("long").alias("least"))
        return F.aggregate(moves, start, step, lambda a: a["least"])

    return let(F.transform(F.split(s, ""), lambda c: number(F.instr(F.lit(alphabet), c))), slid)


def best_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest entropy, in bits per symbol, of any window over s."""
    return F.lit(math.log2(window)) - least_sum(s, alphabet, window) / F.lit(float(UNIT) * window)


def _allowed(s: Column) -> Column:
    told = F.lit(False)
    for pattern in ALLOWED:
        told = told | s.rlike(pattern)
    version = lambda p: (F.size(p) > 1) & F.get(p, F.lit(0)).rlike(NUMBER) & F.forall(F.slice(p, F.lit(2), F.size(p)), lambda x: x.rlike(SHORT))
    return told | F.forall(F.split(s, MARKS, -1), lambda x: x.rlike(WORDS)) | let(F.split(s, POINTS, -1), version)


def _random(s: Column) -> Column:
    test = F.lit(False)
    for pattern, alphabet, least in reversed(CLASSES.values()):
        test = F.when(s.rlike(pattern), best_entropy(s, alphabet) >= least).otherwise(test)
    return F.when(_allowed(s), F.lit(False)).otherwise(test)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans: array<struct<start, rank, end>>, by start, then kind as in KINDS."""
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    t = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (
        ("assign", MAY_ASSIGN, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= LEAST["assign"]),
        ("access", MAY_ACCESS, ACCESS, lambda h: F.length(h) >= LEAST["access"]),
        ("hex", MAY_HEX, HEX.replace("+", "{%d,}" % LEAST["hex"]), lambda h: F.lit(True)),
    )
    base, rest = [], t
    for kind, may, pattern, keep in kinds:
        base.append(F.when(t.rlike(may), _spans(kind, _located(t, pattern), keep)).otherwise(none))
        rest = F.when(t.rlike(may), _blanked(rest, pattern, keep)).otherwise(rest)
    out = docs.withColumn("base_spans", F.array_sort(F.concat(*base)))
    random = lambda text: _spans("entropy", _located(text, CANDIDATE), _random)
    extra = F.when(t.rlike(CANDIDATE), let(rest, random)).otherwise(none)
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base_spans"), extra)))


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["rank"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each stretch of overlapping spans, which come by start."""

    def cut(chars: Column) -> Column:
        covered = running(spans, F.lit(0), lambda at, x: F.greatest(at, x["end"]))  # by this span and those before it
        before = F.concat(F.array(F.lit(0)), F.slice(covered, F.lit(1), F.size(covered) - 1))
        kept = lambda start, end: F.array_join(F.slice(chars, start + 1, end - start), "")
        pieces = F.zip_with(spans, before, lambda x, at: F.when(x["start"] < at, "").otherwise(F.concat(kept(at, F.greatest(at, x["start"])), F.lit(mark))))
        end = F.element_at(covered, -1)
        return F.concat(F.array_join(pieces, ""), kept(end, F.greatest(end, F.size(chars))))

    return let(F.split(text, ""), cut)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text_col replaced by the mark, overlapping spans by one; all rows stay, null text stays null."""
    names = [quoted(c) for c in docs.columns]
    found = scan(docs.select(F.struct(*names).alias("__scan_row"), F.col(quoted(text_col)).alias("__scan_text")), "__scan_text")
    clean = F.when(F.size("spans") > 0, _redacted(F.col("__scan_text"), F.col("spans"), mark)).otherwise(F.col("__scan_text"))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"__scan_row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])

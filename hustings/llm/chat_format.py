"""Chat formatting in DataFrame functions only.

A source's schema is reduced to its nested field paths (arrays marked []), sorted and hashed: the fingerprint. A registry of
declarative mappings, one per fingerprint, says where the turns, roles and texts of that layout are, so that rows-by-turn,
message arrays, prompt/completion and instruction layouts all become canonical rows (conv_id, turns: array<struct<role, text>>).
Formatting marks each turn, escapes control strings inside texts reversibly, and keeps the loss mask as code-point spans of
the assistant texts; parsing reads turns and loss text back from the formatted string alone and its mask.

Null text counts as empty and null role as empty. Turns are ordered by turn (null last), then role, then text, so repeated
turn numbers have a defined order and repeated rows repeat. Rows of a null conv_id are one conversation. A conversation
without rows doesn't appear; an empty table gives an empty result. A single conversation is one row of the output by
contract, so its turns meet in one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hustings.llm.higher_order import let, running

#: Control strings of common chat templates, escaped wherever a text holds them.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaf fields, e.g. messages[].content."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _mapping(paths: str, **how) -> tuple[str, dict]:
    return fingerprint(paths.split()), how


#: fingerprint -> mapping. `rows`: one row per turn. `list`: an array of messages. `parts`: (role, field) in order, null parts left out.
#: `also` (role, field) comes before a list. `roles` renames the source's roles.
MAPPINGS = dict([
    _mapping("conv_id turn role text", rows=("conv_id", "turn", "role", "text")),
    _mapping("conv_id messages[].role messages[].content", id="conv_id", list=("messages", "role", "content")),
    _mapping("id messages[].role messages[].content", id="id", list=("messages", "role", "content")),
    _mapping("id conversations[].from conversations[].value", id="id", list=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    _mapping("id system conversations[].from conversations[].value", id="id", also=("system", "system"), list=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    _mapping("id prompt completion", id="id", parts=(("user", "prompt"), ("assistant", "completion"))),
    _mapping("id prompt response", id="id", parts=(("user", "prompt"), ("assistant", "response"))),
    _mapping("id question answer", id="id", parts=(("user", "question"), ("assistant", "answer"))),
    _mapping("id instruction input output", id="id", parts=(("user", ("instruction", "input")), ("assistant", "output"))),
    _mapping("id instruction output", id="id", parts=(("user", "instruction"), ("assistant", "output"))),
    _mapping("id data.prompt data.answer", id="id", parts=(("user", "data.prompt"), ("assistant", "data.answer"))),
])


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _renamed(role: Column, names: dict[str, str]) -> Column:
    out = role
    for was, now in names.items():
        out = F.when(role == was, now).otherwise(out)
    return out


def canonical(source: DataFrame, mappings: dict[str, dict] = MAPPINGS) -> DataFrame:
    """(conv_id, turns) of any layout in the registry; ValueError names the paths of one that isn't."""
    paths = field_paths(source.schema)
    how = mappings.get(fingerprint(paths))
    if how is None:
        raise ValueError(f"no mapping for the layout {paths}")
    names = how.get("roles", {})
    if "rows" in how:
        conv, turn, role, text = (F.col(c) for c in how["rows"])
        item = F.struct(turn.isNull().alias("last"), turn.alias("turn"), _turn(_renamed(role, names), text).alias("t"))
        return source.groupBy(conv.alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("turns"))
    if "list" in how:
        field, role, text = how["list"]
        turns = F.transform(F.col(field), lambda m: _turn(_renamed(m[role], names), m[text]))
        turns = F.coalesce(turns, F.array().cast(TURNS))
        if "also" in how:
            role, field = how["also"]
            turns = F.concat(F.when(F.col(field).isNotNull(), F.array(_turn(F.lit(role), F.col(field)))).otherwise(F.array().cast(TURNS)), turns)
    else:
        parts = []
        for role, field in how["parts"]:
            fields = [F.col(f) for f in ((field,) if isinstance(field, str) else field)]
            text = F.concat_ws("\n", *[F.when(f != "", f) for f in fields]) if len(fields) > 1 else fields[0]
            parts.append(F.when(F.coalesce(*fields).isNotNull(), _turn(F.lit(role), text)).otherwise(F.lit(None).cast("struct<role:string,text:string>")))
        turns = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return source.select(F.col(how["id"]).alias("conv_id"), turns.alias("turns"))


def escape(text: Column) -> Column:
    r"""Backslashes are doubled; the first character of a control string becomes \l for < and \b for [, so none is left."""
    rest = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROLS if c[0] == "<")
    square = "|".join(c[1:].replace("]", r"\]") for c in CONTROLS if c[0] == "[")
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, f"<(?={rest})", r"\\l")
    return F.regexp_replace(out, rf"\[(?={square})", r"\\b")


def unescape(text: Column) -> Column:
    r"""Undoes escape: whatever lies between pairs of backslashes holds only \l, \b and, in roles, \n."""
    one = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def format_turns(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss): loss is array<struct<start, end>>, code points from 0, end exclusive, in order."""
    piece = lambda t: F.struct(
        F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"),
        (t["role"] == loss_role).alias("learn"),
    )
    pieces = conversations.select("conv_id", F.transform("turns", piece).alias("pieces"))
    tail = len(CLOSE) + 1

    def spans(ends: Column) -> Column:
        close = lambda p, e: F.struct((e - tail - F.length(p["body"])).alias("start"), (e - tail).alias("end"), p["learn"].alias("learn"))
        return F.transform(F.filter(F.zip_with("pieces", ends, close), lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"]))

    loss = let(running(F.col("pieces"), F.lit(0), lambda at, p: at + F.length(p["head"]) + F.length(p["body"]) + tail), spans)
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    return pieces.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """The input's columns with turns (read from `formatted` alone) and loss_text (what the mask `loss` covers), both unescaped."""
    tail = len(CLOSE) + 1
    part = lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - tail)).alias("text"),
    )
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    parts = F.slice(parts, 2, F.size(parts))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumns({"turns": F.transform(parts, part), "loss_text": loss})

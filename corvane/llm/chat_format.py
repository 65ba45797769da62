"""Operator 9: chat formatting, with layouts recognised by fingerprints of their field paths."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from corvane.llm.common import bounded_batches, table

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TURNS = "array<struct<role string, text string>>"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A record layout: the field paths it is known by, and which of them make its turns.

    Either a list of turns with fields for role and text, or the fields of one
    question (joined by an empty line where not empty) and of its answer, or
    rows of a table, one for each turn, with a key, an order, a role and a text.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    pair: tuple[tuple[str, ...], str] | None = None
    rows: tuple[str, str, str, str] | None = None


#: Layouts of single records (structs or JSON texts).
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout("turns", ("turns[].role", "turns[].text"), turns=("turns", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout("prompt", ("completion", "prompt"), pair=(("prompt",), "completion")),
    Layout("prompt_response", ("prompt", "response"), pair=(("prompt",), "response")),
    Layout("instruction", ("instruction", "output"), pair=(("instruction",), "output")),
    Layout("instruction_input", ("input", "instruction", "output"), pair=(("instruction", "input"), "output")),
)
#: Layouts of tables that hold a conversation in several rows.
ROW_LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("message_rows", ("content", "conversation_id", "message_id", "role"), rows=("conversation_id", "message_id", "role", "content")),
)


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a nested type, [] standing for an array's elements."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value: object, at: str = "") -> set[str]:
    """The same of a parsed JSON value; a list or object without leaves below it is a leaf itself."""
    if isinstance(value, dict):
        below = {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
        return below or {at}
    if isinstance(value, list):
        below = {p for v in value for p in value_paths(v, f"{at}[]")} - {f"{at}[]"}
        return below or {f"{at}[]"}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_by(layout: Layout) -> list[tuple[str, ...]]:
    """Sets of paths that a layout is known by; an empty list of turns is known by its name alone."""
    return [layout.paths, (f"{layout.turns[0]}[]",)] if layout.turns else [layout.paths]


def prints_of(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """Layouts by the fingerprints of their paths."""
    return {fingerprint(p): x for x in layouts for p in known_by(x)}


def recognise(paths: Iterable[str], prints: dict[str, Layout]) -> Layout | None:
    """The layout that the paths' fingerprint names; failing that, one whose own paths are all there, each known by their fingerprint.

    Of several the one of most paths, then one with a list of turns. Layouts of
    rows that are still equal go by their order; records whose layouts are, such
    as one of a question with two answers, have none.
    """
    found = set(paths)
    if exact := prints.get(fingerprint(found)):
        return exact
    inside = [(len(own), x.turns is not None, x) for x in dict.fromkeys(prints.values()) for own in known_by(x) if prints.get(fingerprint(found.intersection(own))) is x]
    most = max((m[:2] for m in inside), default=None)
    best = [x for *m, x in inside if tuple(m) == most]
    return best[0] if len(best) == 1 or best and best[0].rows else None


def _tidy(turns: Column) -> Column:
    """Roles in their canonical names; a null role or text is empty, a null turn is left out."""
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    role = lambda t: F.coalesce(F.try_element_at(names, t["role"]), t["role"], F.lit(""))
    return F.transform(F.filter(turns, lambda t: t.isNotNull()), lambda t: F.struct(role(t).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def turns_of(record: Column, layout: Layout) -> Column:
    """Turns of a struct column by its layout's mapping; null for a null record."""
    if layout.turns:
        items, role, text = layout.turns
        return F.transform(record[items], lambda m: F.when(m.isNotNull(), _turn(m[role], m[text])))
    asked, answer = layout.pair
    ask = F.concat_ws("\n\n", *(F.nullif(record[x].cast("string"), F.lit("")) for x in asked))
    return F.when(record.isNotNull(), F.array(_turn(F.lit("user"), ask), _turn(F.lit("assistant"), record[answer])))


def _said(value: object) -> str | None:
    """A leaf as text: strings as they are, anything else as JSON writes it. Halves of surrogate pairs become U+FFFD."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def mapped(record: dict, layout: Layout) -> list[dict | None]:
    """The same of a parsed JSON record."""
    if layout.turns:
        items, role, text = layout.turns
        return [{"role": _said(m.get(role)), "text": _said(m.get(text))} if isinstance(m, dict) else None for m in record[items]]
    asked, answer = layout.pair
    ask = "\n\n".join(x for x in map(_said, map(record.get, asked)) if x)
    return [{"role": "user", "text": ask}, {"role": "assistant", "text": _said(record.get(answer))}]


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _reader(layouts: tuple[Layout, ...]):
    """Layout name and turns of JSON texts, each by its own fingerprint, which is looked up once for each set of paths."""
    prints = prints_of(layouts)

    def read(texts: pa.Array) -> pa.Array:
        by_paths: dict[frozenset[str], Layout | None] = {}
        names, turns = [], []
        for text in texts.to_pylist():
            layout = None
            try:
                record = json.loads(text, parse_constant=_no_constant) if text else None
                if isinstance(record, dict):
                    paths = frozenset(value_paths(record))
                    if paths not in by_paths:
                        by_paths[paths] = recognise(paths, prints)
                    layout = by_paths[paths]
            except (ValueError, RecursionError):
                pass
            names.append(layout and layout.name)
            turns.append(mapped(record, layout) if layout else None)
        turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(turns, turn_type)], ["layout", "turns"])

    return read


def canonical_turns(chats: DataFrame, layouts: tuple[Layout, ...] | None = None, row_layouts: tuple[Layout, ...] | None = None) -> DataFrame:
    """``conv_id``, ``layout`` and ``turns`` (role, text) of conversations in any known layout.

    chats is a table with one row for each turn or, if its columns make none of
    the layouts of rows, has a column ``record`` beside ``conv_id``. A
    fingerprint, a hash of nested field paths, picks the mapping: that of the
    table's columns, that of a struct record's type, or, for JSON texts, that of
    each record's own paths. Fields and columns beyond a layout's are left
    aside, whatever their names, those of other layouts too (see recognise).

    A table or struct of no known layout is an error; a JSON text of none or of
    two alike, and one that is null or no JSON object, gets a null layout and
    null turns. A null role or text is empty, a null turn is left out. Rows are
    in the order given (null first), then by role and text; rows that repeat are
    turns of their own. Rows of a null key are one conversation, however many. An
    empty table stays empty. A conversation, that of the null key too, is
    gathered whole in one task, however long its texts, being one formatted text
    in the end.
    """
    layouts, row_layouts = LAYOUTS if layouts is None else layouts, ROW_LAYOUTS if row_layouts is None else row_layouts
    layout = recognise(chats.columns, prints_of(row_layouts))
    if layout is None and "record" not in chats.columns:
        raise ValueError(f"no layout has the columns {sorted(chats.columns)}")
    if layout is not None:
        key, *fields = layout.rows
        rows = chats.select(F.col(key).alias("conv_id"), F.struct(*(F.col(f"`{f}`").alias(x) for f, x in zip(fields, ("nth", "role", "text")))).alias("turn"))
        grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("m"))
        return grouped.select("conv_id", F.lit(layout.name).alias("layout"), _tidy(F.transform("m", lambda x: _turn(x["role"], x["text"]))).alias("turns"))
    kind = chats.schema["record"].dataType
    if isinstance(kind, StructType):
        layout = recognise(field_paths(kind), prints_of(layouts))
        if layout is None:
            raise ValueError(f"no layout has the fields {sorted(field_paths(kind))}")
        turns = turns_of(F.col("record"), layout)
        return chats.select("conv_id", F.when(turns.isNotNull(), F.lit(layout.name)).alias("layout"), _tidy(turns).alias("turns"))
    read = chats.select("conv_id", _udf(_reader(layouts), f"layout string, turns {TURNS}")("record").alias("read"))
    return read.select("conv_id", "read.layout", _tidy(F.col("read.turns")).alias("turns"))


def escape(text: str) -> str:
    """No '<|' is left: each gets a caret between, and those with carets one more."""
    return re.sub(r"<(\^*)\|", r"<\1^|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\^*)\^\|", r"<\1|", text)


def render(turns: pa.Array) -> pa.Array:
    """The formatted text and the code points (end exclusive) under the loss mask: the assistant's texts."""
    texts, masks = [], []
    for conversation in turns.to_pylist():
        parts, mask, at = [], [], 0
        for t in conversation or ():
            head, body = f"{START}{escape(t['role'])}{MIDDLE}", escape(t["text"])
            if t["role"] == "assistant":
                mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += head, body, END
            at += len(head) + len(body) + len(END)
        texts.append(None if conversation is None else "".join(parts))
        masks.append(None if conversation is None else mask)
    mask_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(masks, mask_type)], ["formatted", "loss"])


def read_back(formatted: pa.Array, loss: pa.Array) -> pa.Array:
    """The turns of a formatted text, and the text under its mask, both unescaped."""
    turns, under = [], []
    for text, mask in zip(formatted.to_pylist(), loss.to_pylist()):
        found = [x.removesuffix(END).split(MIDDLE) for x in (text or "").split(START)[1:]]
        turns.append(None if text is None else [{"role": unescape(r), "text": unescape(b)} for r, b in found])
        under.append(None if text is None else "".join(unescape(text[m["start"] : m["end"]]) for m in mask))
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.StructArray.from_arrays([pa.array(turns, turn_type), pa.array(under, pa.string())], ["turns", "loss"])


def _udf(f, kind: str):
    """Marked so that Spark doesn't copy the call into each use of its fields."""
    return F.arrow_udf(f, kind).asNondeterministic()


def format_chats(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``layout``, ``formatted`` and ``loss`` (code points under the loss mask) of what canonical_turns gives.

    Turns stand between marks; control strings inside texts and roles are
    escaped so that reading back restores them. Null turns give a null
    formatted text, no turns an empty one.
    """
    bounded_batches(chats.sparkSession)
    made = chats.select("conv_id", "layout", _udf(render, "formatted string, loss array<struct<start int, end int>>")("turns").alias("made"))
    return made.select("conv_id", "layout", "made.formatted", "made.loss")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted texts and their masks."""
    back = formatted.withColumn("back", _udf(read_back, f"turns {TURNS}, loss string")("formatted", "loss"))
    said = F.array_join(F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back.turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("back.loss").cast("long").alias("loss_chars"),
        F.sha2("back.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


TRICKY = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations, in its own layout of rows, and conversation -1, a JSON record in another layout."""
    said = [{"role": role, "content": TRICKY} for role in ("user", "assistant")]
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps({"messages": said})).alias("record"))
    return digests(format_chats(canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(extra))))


_ESCAPED = "regexp_replace({}, '<(\\^*)\\|', '<\\1^|', 'g')"
_FIXED = len(START) + len(MIDDLE) + len(END)
SQL = f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '') AS role,
               coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{TRICKY}' FROM range(2) r(i)
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({_FIXED} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
"""

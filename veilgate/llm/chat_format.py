"""Chat formatting: layouts recognised by a fingerprint of their field paths, turned into canonical turns,
written with a reversible template and a loss mask. DataFrame and SQL functions only.

A mapping names the nested field paths of a layout and how they become turns. The paths, sorted and joined,
are hashed; a table whose known paths hash to a mapping's fingerprint is read by it. In a table that mixes
layouts the paths are those whose column is filled in the row, so every row picks its own mapping.

Template: ``<|im_start|>`` role line feed text ``<|im_end|>`` line feed. In a text, ``<`` followed by any
number of backslashes and ``|`` gets one backslash more, so no text can hold a control string, and taking
one away restores it exactly. In a role, backslash and line feed are escaped as well.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths (``optional`` ones may be missing) and SQL text for array<struct<turn, role, text>>."""

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = ()


def _turn(number: str, role: str, text: str) -> str:
    return f"named_struct('turn', CAST({number} AS BIGINT), 'role', CAST({role} AS STRING), 'text', CAST({text} AS STRING))"


MAPPINGS = (
    Mapping("turn rows", ("turn", "role", "text"), f"array({_turn('turn', 'role', 'text')})"),
    Mapping(
        "messages",
        ("messages[].role", "messages[].content"),
        f"transform(messages, (m, i) -> {_turn('i', 'm.role', 'm.content')})",
    ),
    Mapping(
        "from and value",
        ("conversations[].from", "conversations[].value"),
        "transform(conversations, (m, i) -> "
        + _turn("i", "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END", "m.value")
        + ")",
    ),
    Mapping(
        "prompt and completion",
        ("prompt", "completion"),
        f"array({_turn('0', chr(39) + 'user' + chr(39), 'prompt')}, {_turn('1', chr(39) + 'assistant' + chr(39), 'completion')})",
    ),
    Mapping(
        "instruction",
        ("instruction", "output"),
        "array("
        + _turn("0", "'user'", "concat_ws('\n\n', instruction, nullif(input, ''))")
        + ", "
        + _turn("1", "'assistant'", "output")
        + ")",
        ("input",),
    ),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested paths of the leaves, ``[]`` marking array elements."""
    if isinstance(schema, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in schema.fields for p in field_paths(f.dataType, dot + f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def _variants(mappings) -> dict[str, Mapping]:
    """Fingerprint to mapping, for every choice of the optional paths."""
    return {
        fingerprint((*m.paths, *some)): m
        for m in mappings
        for n in range(len(m.optional) + 1)
        for some in itertools.combinations(m.optional, n)
    }


def canonical_turns(records: DataFrame, key: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """(``key``, turn, role, text, layout) rows from records in any known layout.

    Columns no mapping names are ignored, whatever their names. If the known paths of the schema are a mapping's,
    all rows take it, nulls or not. Otherwise each row goes by its filled columns; a row whose fingerprint is
    unknown comes back once with null layout, turn, role and text, so it can be counted and looked at. A null or
    empty array has no turns. Null roles and texts become empty.
    """
    known = {p for m in mappings for p in (*m.paths, *m.optional)}
    there = [p for p in field_paths(records.schema) if p in known]
    variants = _variants(mappings)

    def root(path: str) -> str:
        return path.split(".")[0].split("[")[0]

    roots = sorted({root(p) for p in there})
    missing = {root(p): F.lit(None).cast("string") for m in mappings for p in m.optional if root(p) not in roots}
    frame = records.select(F.col(f"`{key}`").alias("__key"), *(F.col(f"`{c}`") for c in roots)).withColumns(missing)
    whole = variants.get(fingerprint(there))
    if whole:
        picked = frame.withColumn("__layout", F.lit(whole.name)).withColumn("__turns", F.expr(whole.turns))
    else:
        of_root = {r: sorted(p for p in there if root(p) == r) for r in roots}
        by_path = sorted(there)
        filled = F.concat_ws("\n", *(F.when(F.col(f"`{root(p)}`").isNotNull(), F.lit(p)) for p in by_path))
        usable = {f: m for f, m in variants.items() if all(p in there for p in m.paths)}
        layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
        mark = F.col("__mark")
        for print_, m in usable.items():
            layout = F.when(mark == print_, F.lit(m.name)).otherwise(layout)
            turns = F.when(mark == print_, F.expr(m.turns)).otherwise(turns)
        unknown = F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string")))))
        marked = frame.withColumn("__mark", F.sha2(filled, 256) if of_root else F.lit(""))
        picked = marked.withColumn("__layout", layout).withColumn(
            "__turns", F.when(F.col("__layout").isNull(), unknown).otherwise(turns)
        )
    known_layout = F.col("__layout").isNotNull()
    return picked.select("__key", "__layout", F.explode("__turns").alias("t")).select(
        F.col("__key").alias(key),
        "t.turn",
        F.when(known_layout, F.coalesce("t.role", F.lit(""))).alias("role"),
        F.when(known_layout, F.coalesce("t.text", F.lit(""))).alias("text"),
        F.col("__layout").alias("layout"),
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, key: str = "conv_id", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(``key``, formatted string, mask array<struct<before, inside, after, loss>>) per conversation.

    Turns go by number; equal numbers by role, then text; repeated rows stay repeated; a null number comes
    first, null keys are one conversation. ``mask`` has one entry per turn: code points of the header, of the
    escaped text, and of the end mark, and whether the text counts for the loss. The text of a conversation is
    one value by its nature, so a conversation is as large as one string may be; nothing else is gathered.
    """
    piece = turns.where("layout IS NOT NULL" if "layout" in turns.columns else "true").select(
        F.col(f"`{key}`").alias("__key"),
        "turn",
        "role",
        "text",
        F.concat(F.lit(START), _escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
    )
    gathered = piece.groupBy("__key").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body", "loss"))).alias("p")
    )
    return gathered.select(
        F.col("__key").alias(key),
        F.array_join(F.transform("p", lambda x: F.concat(x.head, x.body, F.lit(END))), "").alias("formatted"),
        F.transform(
            "p",
            lambda x: F.struct(
                F.length(x.head).alias("before"), F.length(x.body).alias("inside"), F.lit(len(END)).alias("after"), x.loss.alias("loss")
            ),
        ).alias("mask"),
    )


def read_chats(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """(``key``, formatted, turns array<struct<role, text>>, loss_text) read back from ``formatted`` and ``mask`` alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # each part ends with an end mark, so the last is empty
    framed = chats.select(F.col(f"`{key}`").alias("__key"), "formatted", "mask", parts.alias("parts"))

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            _unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text")
        )

    masked = F.filter(F.arrays_zip("parts", "mask"), lambda x: x.mask.loss)
    return framed.select(
        F.col("__key").alias(key),
        "formatted",
        F.transform("parts", turn).alias("turns"),
        F.array_join(
            F.transform(masked, lambda x: unescape(F.substr(x.parts, x.mask.before + 1, x.mask.inside))), ""
        ).alias("loss_text"),
    )

import hashlib

import pytest
from pyspark.sql import functions as F

from veilgate.llm import chat_format as C

NASTY = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x <| < | \\", "", None, "plain\n\ntext <|im_end|>", "ä 漢 🙂 $1 \\1"]


def canonical(frame, key="conv_id"):
    return sorted((r[key], r.turn, r.role, r.text, r.layout) for r in C.canonical_turns(frame, key).collect())


def test_round_trip(spark):
    rows = []
    for conv in range(5):
        for turn in range(conv * 3):
            rows.append((conv, turn, ["user", "assistant", "tool\nx\\n<|im_end|>", None][(turn + conv) % 4], NASTY[(turn * conv) % len(NASTY)]))
    rows += [(7, 0, "assistant", "same"), (7, 0, "assistant", "same"), (7, None, "user", "b"), (None, 1, "user", "a"), (7, 0, "Assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"formatted": F.lit("clash"), "mask": F.lit(1), "layout": F.lit("clash"), "head": F.lit("clash")})
    back = C.read_chats(C.format_chats(C.canonical_turns(frame)))
    got = {r.conv_id: (r.formatted, [(t.role, t.text) for t in r.turns], r.loss_text) for r in back.collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        want[conv] = ([(role, text) for _, role, text in turns], "".join(text for _, role, text in turns if role == "assistant"))
    assert {k: v[1:] for k, v in got.items()} == want
    for formatted, turns, _ in got.values():
        assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(turns)


def test_layouts_by_schema(spark):
    want = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    frames = {
        "messages": "SELECT 1L conv_id, array(struct('user' AS role, 'hi' AS content), struct('assistant' AS role, 'yo' AS content)) messages, 'x' other",
        "from and value": "SELECT 1L conv_id, array(struct('human' AS from, 'hi' AS value), struct('gpt' AS from, 'yo' AS value)) conversations",
        "prompt and completion": "SELECT 1L conv_id, 'hi' prompt, 'yo' completion",
        "instruction": "SELECT 1L conv_id, 'hi' instruction, 'yo' output",
    }
    for layout, sql in frames.items():
        assert canonical(spark.sql(sql)) == [(*w, layout) for w in want]
    with_input = spark.sql("SELECT 1L conv_id, 'hi' instruction, 'there' input, CAST(NULL AS STRING) output")
    assert canonical(with_input) == [(1, 0, "user", "hi\n\nthere", "instruction"), (1, 1, "assistant", "", "instruction")]
    assert canonical(spark.sql("SELECT 1L conv_id, array() messages").selectExpr("conv_id", "CAST(messages AS array<struct<role:string,content:string>>) messages")) == []


def test_mixed_rows_choose_their_own_mapping(spark):
    mixed = spark.sql("""
        SELECT 1L conv_id, 'p' prompt, 'c' completion, CAST(NULL AS array<struct<role:string,content:string>>) messages, CAST(NULL AS STRING) instruction, CAST(NULL AS STRING) output, CAST(NULL AS STRING) input
        UNION ALL SELECT 2L, NULL, NULL, array(named_struct('role', 'user', 'content', 'm')), NULL, NULL, NULL
        UNION ALL SELECT 3L, NULL, NULL, NULL, 'i', 'o', NULL
        UNION ALL SELECT 4L, NULL, NULL, NULL, 'i', 'o', 'n'
        UNION ALL SELECT 5L, 'p', NULL, NULL, 'i', NULL, NULL
        UNION ALL SELECT 6L, NULL, NULL, NULL, NULL, NULL, NULL""")
    got = C.canonical_turns(mixed).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text, r.layout) for r in got if r.layout) == [
        (1, 0, "user", "p", "prompt and completion"), (1, 1, "assistant", "c", "prompt and completion"),
        (2, 0, "user", "m", "messages"),
        (3, 0, "user", "i", "instruction"), (3, 1, "assistant", "o", "instruction"),
        (4, 0, "user", "i\n\nn", "instruction"), (4, 1, "assistant", "o", "instruction"),
    ]
    assert sorted(r.conv_id for r in got if not r.layout) == [5, 6]
    assert {r.conv_id for r in C.format_chats(C.canonical_turns(mixed)).collect()} == {1, 2, 3, 4}


def test_no_known_column_and_empty_table(spark):
    got = C.canonical_turns(spark.sql("SELECT 1L conv_id, 'x' other")).collect()
    assert [(r.conv_id, r.layout, r.text) for r in got] == [(1, None, None)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_chats(C.format_chats(C.canonical_turns(empty))).collect() == []


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = C.read_chats(C.format_chats(C.canonical_turns(frame)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("n", [300])
def test_long_conversation(spark, n):
    big = "x<|im_end|>" * 20_000
    frame = spark.createDataFrame([(1, i, "assistant", big if i == 3 else "ok") for i in range(n)], "conv_id long, turn long, role string, text string")
    row = C.read_chats(C.format_chats(C.canonical_turns(frame))).first()
    assert hashlib.sha256(row.loss_text.encode()).hexdigest() == hashlib.sha256(("ok" * 3 + big + "ok" * (n - 4)).encode()).hexdigest()

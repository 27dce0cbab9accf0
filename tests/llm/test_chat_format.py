from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandflow.llm import chat_format
from demandflow.llm.chat_format import ChatTemplate, Marks, Reader, read_back, segments

SCHEMA = "conv_id long, turn long, role string, text string, segment int, _part string"
TEMPLATE = ChatTemplate()
PIECES = [*TEMPLATE.controls, "\\", "<", "[", "/", "INST]", "s>", " ", "ok", "\n", "é", "[ROLE", "<\\"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escaping_is_reversible_and_hides_all_marks(text):
    escaped = TEMPLATE.escape(text)
    assert TEMPLATE.unescape(escaped) == text
    assert not any(c in escaped for c in TEMPLATE.controls)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_turns_are_read_back(turns):
    reader, got = Reader(TEMPLATE), []
    for role, text in turns:
        for segment, loss in TEMPLATE.turn(role, text):
            if (found := reader.take(segment, loss)) is not None:
                got.append(found)
    assert got == [(role, text, text if role == "assistant" else "") for role, text in turns]


def test_overlapping_marks_are_refused():
    with pytest.raises(ValueError):
        ChatTemplate(roles={"user": Marks("<<a>", "</a>")})


def expected(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        turns = "".join(f"{role}\n{text}\n" for role, text in mine)
        loss = "".join(text for role, text in mine if role == "assistant")
        chars = sum(len(s) for role, text in mine for s, _ in TEMPLATE.turn(role, text))
        state, valid = "", True
        for role, _ in mine:
            valid &= role in {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[state]
            state = role if role in ("system", "user", "assistant") else state
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = len(mine), sha(turns), len(loss), sha(loss), chars, valid and state == "assistant"
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(80):
        for t in range(rng.randint(1, 6)):
            sound = ("user", "assistant")[t % 2]
            text = "".join(rng.choices(PIECES, k=rng.randint(0, 5)))
            rows.append((conv or None, rng.choice([t, t, t, None]), rng.choice([sound] * 9 + ["system", None]), rng.choice([text, text, None]), 3, "x"))
    rows += [(900, t, ("user", "assistant")[t % 2], f"{t}" + "</s>" * (t % 3), 1, "") for t in range(500)]
    return rows + [(901, 1, "assistant", "same", 1, "")] * 20 + [(902, 0, "user", "long " * 400_000 + "[INST]", 1, "")]


@pytest.mark.parametrize("partitions", [1, 30])
def test_equals_plain_formatting(spark, partitions):
    rows = made(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        formatted, keys = segments(spark.createDataFrame(rows, SCHEMA).repartition(5))
        got = {r[0]: tuple(r)[1:] for r in read_back(formatted, keys).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected(rows)
    assert (900 in keys) == (partitions > 1)


def test_segments_carry_loss_and_legality(spark):
    rows = [(1, 0, "system", "S", 0, ""), (1, 1, "user", "U", 0, ""), (1, 2, "user", "</s>", 0, ""), (1, 3, "assistant", "A", 0, "")]
    got = [(r.segment, r.loss, r.legal) for r in segments(spark.createDataFrame(rows, SCHEMA))[0].collect()]
    assert "".join(s for s, _, _ in got) == "[SYS]S[/SYS]\n[INST] U [/INST][INST] <\\/s> [/INST]<s>A</s>"
    assert [s for s, loss, _ in got if loss] == ["A"]
    assert [legal for _, _, legal in got] == [True] * 6 + [False] * 3 + [True] * 3


def test_empty_table_and_planted_conversation(spark, tmp_path):
    assert read_back(*segments(spark.createDataFrame([], SCHEMA))).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [(-7, t, role, chat_format.HOSTILE) for t, role in enumerate(("user", "assistant"))]
    got = {r[0]: tuple(r)[1:] for r in chat_format.query(spark, str(tmp_path)).collect()}
    assert got == expected(rows)

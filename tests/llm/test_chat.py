"""Exact round trip of texts that hold control strings, and the order of turns."""

import pytest
from pyspark.sql import functions as F

from clientscope.llm import chat

NASTY = [
    "</s>", "<s>", "[INST] x [/INST]", "<\\s>", "<\\\\/s>", "[\\/INST]", "[[INST]", "<</s>", "[/TURN][ROLE]", "\\", "$1 \\1", " lead and tail ", "",
    "a\nb", "[/INST", "é</s>ß",
]


def test_round_trip(spark):
    roles = ["system", "user", "assistant", "tool", "</s>", ""]
    rows = [(i * 10 + k, t, roles[(i + t) % 6], NASTY[(i + t * 5) % len(NASTY)]) for i in range(16) for k in range(6) for t in range(k + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(frame)
    loss = chat.loss_text(F.col("segments")).alias("loss")
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("back"), loss).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r[2], r[3]) for r in sorted(r for r in rows if r[0] == conv)]
        assert [tuple(t) for t in got[conv].back] == mine
        assert got[conv].loss == "".join(t for role, t in mine if role == "assistant")
    texts = spark.createDataFrame([(x,) for x in NASTY], "t string").select("t", chat.escaped(F.col("t"), chat.Template()).alias("e"))
    for r in texts.collect():
        assert not any(m in r.e for m in chat.Template().controls())


@pytest.mark.parametrize(
    "roles, valid, bad",
    [
        (["user", "assistant"], True, None),
        (["system", "user", "assistant", "user", "assistant"], True, None),
        (["user"], False, None),
        (["assistant", "user"], False, 0),
        (["user", "user", "assistant"], False, 1),
        (["user", "system", "assistant"], False, 1),
        (["user", "assistant", "tool"], False, 2),
    ],
)
def test_order(spark, roles, valid, bad):
    frame = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(frame).first()
    assert (r.valid, r.bad_turn) == (valid, bad)


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Template(begin="<<s>")
    with pytest.raises(ValueError):
        chat.Template(begin="</s")

import hashlib
import re

import pytest
from cases import write

from tallyrock.llm import chat

EVENTS = "conv_id long, seq long, message int, kind string, role string, text string"


def folded(spark, events):
    return [(r.conv_id, r.message, r.role, r.text) for r in chat.fold(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "message").collect()]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "lo"), (1, 2, 1, "delta", None, "hel"), (1, 4, 0, "edit", None, "hello?"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "yes"),
        (2, 1, 0, "message", "user", "a"), (2, 2, 1, "message", "assistant", "b"), (2, 3, 2, "message", "user", "c"), (2, 4, 1, "regenerate", None, "dropped"), (2, 5, 1, "delta", None, "B"), (2, 6, 3, "message", "user", "d"),
        (3, 0, 0, "delta", "assistant", "only "), (3, 1, 0, "delta", None, "deltas"), (None, None, None, None, None, None), (4, 0, 0, None, "user", "null kind"),
    ]
    assert folded(spark, events) == [
        (None, None, "", ""), (1, 0, "user", "hello?"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (2, 1, "assistant", "B"), (2, 3, "user", "d"), (3, 0, "assistant", "only deltas"), (4, 0, "user", "null kind"),
    ]
    assert folded(spark, []) == []


TRICKY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>\\", "<\\s>", "[INST", "</s", "<s><s></s></s>", "a\nb", "[/INST]</s>", "😀</s>", "<</s>>", "\\<s>"]


def test_round_trip(spark):
    rows = [(i, 0, role, t) for i, t in enumerate(TRICKY) for role in ["user"]] + [(100 + i, 0, t, "x") for i, t in enumerate(TRICKY)] + [(200, i, "assistant", t) for i, t in enumerate(TRICKY)]
    messages = spark.createDataFrame(rows, "conv_id long, message int, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.render(messages)).collect()}
    for i, t in enumerate(TRICKY):
        assert got[i] == [("user", t)] and got[100 + i] == [(t, "x")]
    assert got[200] == [("assistant", t) for t in TRICKY]


def test_spans_and_mask(spark):
    """The spans are where the escaped texts lie, and under the mask lies each assistant's text once, in order; also over many turns."""
    from pyspark.sql import functions as F

    turns = [("assistant" if i % 3 else "user", t) for i, t in enumerate(TRICKY)]
    many = [(("user", "assistant")[i % 2], f"{i} </s>é😀" * (i % 4)) for i in range(4500)]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, i, r, t) for i, (r, t) in enumerate(many)] + [(3, 0, "system", "x")]
    read = chat.parse(chat.render(spark.createDataFrame(rows, "conv_id long, message int, role string, text string")))
    read = read.withColumn("mask", chat.loss_mask(F.col("turns"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask")))
    got = {r.conv_id: r for r in read.collect()}
    for conv, said in ((1, turns), (2, many)):
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == said
        escaped = [r.formatted[t.start : t.end] for t in r.turns]
        assert all(re.sub(r"(?s)\\(.)", r"\1", e) == t for e, (_, t) in zip(escaped, said, strict=True))
        assert [(m.start, m.end, m.learn) for m in r.mask] == [(t.start, t.end, t.role == "assistant") for t in r.turns]
        assert r.loss == "".join(t for role, t in said if role == "assistant")
    assert got[3].loss == ""


def test_log_of_conversations(spark):
    """The log that the query folds has every kind of event, and folds to the conversations."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 1000), (1, 2, None, None), (1, 2, "user", ""), (2, 5, "assistant", "é" * 64)]
    log = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.filter("kind = 'delta' and conv_id = 1 and message = 2").count() > 8
    got = [(r.conv_id, r.message, r.role, r.text) for r in chat.fold(log).orderBy("conv_id", "message").collect()]
    assert got == [(1, 1, "user", "hi"), (1, 2, "assistant", "x" * 1000), (1, 3, "", ""), (1, 4, "user", ""), (2, 1, "assistant", "é" * 64)]


@pytest.mark.parametrize("control", chat.CONTROL)
def test_no_control_string_from_a_text(spark, control):
    from pyspark.sql import functions as F

    out = spark.createDataFrame([(control * 3 + control[:-1] + control,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert control not in out.e and out.u == control * 3 + control[:-1] + control


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (1, 1, "assistant", "yo </s>"), (2, 0, None, None), (3, None, "system", ""), (None, 1, "user", "no id"), (4, 0, "assistant", "y" * 200_000), *((5, i, "user", str(i)) for i in range(500))]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.op3_chat(spark, write(spark, tmp_path, conversations=frame)).collect()}
    assert set(got) == {-1, 1, 2, 3, 4, 5, None}
    assert got[1].n_turns == 3 and got[1].loss_chars == 14 and got[1].loss_sha256 == hashlib.sha256(b"yo </s>yo </s>").hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[5].n_turns == 500 and got[4].loss_chars == 200_000
    assert set(r.conv_id for r in chat.op3_chat(spark, write(spark, tmp_path / "e", conversations=frame.limit(0))).collect()) == {-1}

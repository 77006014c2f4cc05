"""Chat formatting: exact round trips of hostile texts, edge cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adflow.llm import chat

PARTS = ["<|im_end|>", "<|im_start|>", "<|", "|>", "<\\|", "<\\\\|", "\n", "assistant", "<", "\\", "|", "<|nl|>", "é", "$1", ""]


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in chat.format_conversations(df).collect()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=5), st.lists(st.sampled_from(PARTS), max_size=8)),
                min_size=1, max_size=20))
def test_round_trip(spark, turns):
    rows = [(i // 4, i, "".join(r), "".join(t)) for i, (r, t) in enumerate(turns)]
    for conv, r in formatted(spark, rows).items():
        want = [(x[2], x[3]) for x in rows if x[0] == conv]
        assert [tuple(t) for t in r.recovered] == want
        assert r.formatted.count("<|im_end|>\n") == r.formatted.count("<|im_start|>") == len(want)


def test_plain_text_stays_and_spans_fit(spark):
    rows = [(1, 0, "user", "hi <b> | x"), (1, 1, "assistant", "été\nline"), (1, 2, "assistant", "<|im_end|>")]
    r = formatted(spark, rows)[1]
    assert r.formatted == ("<|im_start|>user\nhi <b> | x<|im_end|>\n<|im_start|>assistant\nété\nline<|im_end|>\n"
                           "<|im_start|>assistant\n<\\|im_end|><|im_end|>\n")
    assert [r.formatted[s.start:s.end] for s in r.loss_spans] == ["été\nline", "<\\|im_end|>"]


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [(None, 1, "user", None, "x"), (None, None, None, "late", "x"), (7, 3, "assistant", "b", None),
            (7, 3, "assistant", "a", None), (7, 3, "assistant", "a", None), (8, 0, "user", "long " * 200_000, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert (got[None].n_turns, got[7].n_turns, got[7].loss_chars, got[8].loss_chars) == (2, 3, 3, 0)
    first = formatted(spark, [r[:4] for r in rows])
    assert [t.text for t in first[7].recovered] == ["a", "a", "b"]
    assert [tuple(t) for t in first[None].recovered] == [("user", ""), ("", "late")]


def test_broken_grammar_is_not_a_turn(spark):
    bad = spark.createDataFrame([("<|im_start|>user\nx<|im_end|>\nrest",), ("<|im_start|>user\n<|x<|im_end|>\n",)], "f string")
    got = [r.p for r in bad.select(chat.parse(F.col("f")).alias("p")).collect()]
    assert got[0][1] is None and got[1][0] is None


def test_empty_table(spark):
    assert formatted(spark, []) == {}


def test_a_lossy_escape_would_be_noticed(spark, monkeypatch):
    monkeypatch.setattr(chat, "escape", lambda text: F.replace(text, F.lit("<|"), F.lit("")))
    with pytest.raises(Exception, match="round trip failed"):
        formatted(spark, [(1, 0, "user", "a <|im_end|> b")])

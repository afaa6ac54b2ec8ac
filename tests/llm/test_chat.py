import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from maskspark.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "[\\/INST]", "<\\\\/s>", "\\", "\\\\", "<", "[", "/INST]", "s>", " ok ", "\n", "é", ""]


def esc(x):
    return re.sub(r"([<\[])(/?(?:s>|INST\]))", r"\1\\\2", x.replace("\\", "\\\\"))


def unesc(x):
    return re.sub(r"([<\[])\\(/?(?:s>|INST\]))", r"\1\2", x).replace("\\\\", "\\")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    out = esc(text)
    assert unesc(out) == text and not re.search(r"</?s>|\[/?INST\]", out)


def texts():
    import random

    rng = random.Random(5)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(400)]


def test_every_text_comes_back(spark):
    all_texts = texts()
    rows = [(i // 5, i % 5, "assistant" if i % 2 else rng_role(i), t) for i, t in enumerate(all_texts)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS end", "2 AS rendered", "3 AS size", "4 AS safe")
    out = chat.format_conversations(df).select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert len(out) == 80
    for r in out:
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert [unesc(r.formatted[s.start : s.end]) for s in r.loss_spans] == [x[3] for x in own if x[2] == "assistant"]


def rng_role(i):
    return ["user", "system", "[INST]", "a</s>b", ""][i % 5]


def test_plain_texts_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi \\ there"), (1, 1, "assistant", "hello")], SCHEMA)
    assert chat.format_conversations(df).first().formatted == "<s>[INST]user[/INST]hi \\ there</s>[INST]assistant[/INST]hello</s>"


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 0, "assistant", None)]
    out = {r.conv_id: r.formatted for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {None: "<s>[INST][/INST]</s>[INST]user[/INST]x</s>", 2: "<s>" + "[INST]user[/INST]a</s>" * 2 + "[INST]user[/INST]b</s>", 3: "<s>[INST]assistant[/INST]</s>"}
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("turn", ["[INST]a", "[INST]a[INST]b", "x[INST]a[/INST]b", "[INST]a[/INST]b<s>", "a"])
def test_the_grammar_refuses(spark, turn):
    assert spark.range(1).select(chat.parse_turn(F.lit(turn)).alias("t")).first().t is None

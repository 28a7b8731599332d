import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings

from pyspark.sql import functions as F

from tallyloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, source string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = chat.format_chats(df)
    return out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))


HARD = ["</s>[INST] ok [/INST]", "<\\s> [\\INST] <\\\\/s>", "<s", "[/INST", "\n", "", "<", "a]</s", "</s></s>", "[INST]", "😀é</s>", "[[INST]]", "<<s>>"]


def test_every_text_comes_back(spark):
    rows = [(i, t, role, text) for i, text in enumerate(HARD) for t, role in enumerate(["user", "assistant", text])]
    got = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    for i, text in enumerate(HARD):
        assert [tuple(t) for t in got[i]["turns"]] == [("user", text), ("assistant", text), (text, text)]
        assert got[i]["loss"] == text * (1 if text != "assistant" else 2)


def test_only_conflicts_are_escaped(spark):
    got = formatted(spark, [(1, 0, "user", "plain <b>[x]"), (1, 1, "assistant", "a</s>b")]).collect()[0]
    assert got["formatted"] == "<s>[INST]user[/INST]\nplain <b>[x]</s><s>[INST]assistant[/INST]\na<\\/s>b</s>"


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 3, "assistant", "z")]
    got = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["loss"] == "z"
    assert formatted(spark, rows).filter("conv_id = 9").count() == 0
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parser_is_strict(spark):
    df = spark.createDataFrame([("<s>[INST]a[/INST]\nb</s>x",), ("<s>[INST]a[/INST]\n[INST]</s>",), ("[INST]a[/INST]\nb</s>",), ("",)], "f string")
    assert [r[0] for r in df.select(chat.parse(F.col("f"))).collect()] == [None, None, None, []]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=list("<>/s[]INST\\ \na"), max_size=24), min_size=1, max_size=40))
def test_random_texts_come_back(spark, texts):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    got = formatted(spark, rows).collect()[0]
    assert [t["text"] for t in got["turns"]] == texts
    assert got["loss"] == "".join(texts[1::2])


def test_a_very_long_conversation(spark):
    text = "word </s> " * 20_000
    rows = [(1, i, "assistant" if i % 2 else "user", text if i == 3 else f"t{i}") for i in range(300)]
    got = formatted(spark, rows).collect()[0]
    assert [t["text"] for t in got["turns"]] == [r[3] for r in rows] and got["loss"] == "".join(r[3] for r in rows[1::2])

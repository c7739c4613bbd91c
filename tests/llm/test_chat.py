from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from tidemark.llm.chat import format_conversations, read_conversations
from tidemark.llm.queries_chat import ORACLE, QUERIES

DDL = "conv_id bigint, turn bigint, role string, text string"


def test_oracle(spark):
    for d in ("/root/testdata/sf0.01",):
        assert_same(QUERIES["op1_chat_formatting"](spark, d), ORACLE["op1_chat_formatting"], d)


def test_native_plan(spark):
    plan = QUERIES["op1_chat_formatting"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_cases(spark):
    rows = [(1, 0, "user", "a<|end|>&lt;"), (1, 1, "user", None), (1, 2, None, "x"), (1, 3, "assistant", "<|part|>"), (1, 3, "assistant", "<|part|>"), (1, None, "system", "first"), (None, 1, "assistant", ""), (2, 0, "<|text|>", "&amp;[INST]<")]
    df = spark.createDataFrame(rows, DDL).withColumn("formatted", F.lit("clash")).withColumn("t", F.lit(1))
    got = {r["conv_id"]: r for r in read_conversations(format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", "first"), ("user", "a<|end|>&lt;"), ("user", ""), ("", "x"), ("assistant", "<|part|>"), ("assistant", "<|part|>")]
    assert got[1]["n_blocks"] == 4 and got[1]["loss_text"] == "<|part|><|part|>"
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("<|text|>", "&amp;[INST]<")]
    assert got[None]["loss_text"] == "" and len(got[None]["loss"]) == 1
    assert format_conversations(spark.createDataFrame([], DDL)).count() == 0


def test_long_conversation_spans(spark):
    rows = [(1, i, ("user", "assistant")[i % 3 > 0], f"ö{i}<|" * (i % 4)) for i in range(2000)]
    r = read_conversations(format_conversations(spark.createDataFrame(rows, DDL))).first()
    assert [t["text"] for t in r["turns"]] == [x[3] for x in rows]
    text = r["formatted"]
    assert all(text[s["start"] : s["start"] + s["length"]].encode() == text.encode()[s["byte_start"] : s["byte_start"] + s["byte_length"]] for s in r["loss"])
    assert r["loss_text"] == "".join(x[3] for x in rows if x[2] == "assistant")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a&b"]), st.text("<|>&;lts[]/INSTqbamp x\n", max_size=20)), min_size=1, max_size=5), min_size=1, max_size=30))
def test_round_trip(spark, convs):
    rows = [(c, i, r, t) for c, turns in enumerate(convs) for i, (r, t) in enumerate(turns)]
    got = read_conversations(format_conversations(spark.createDataFrame(rows, DDL))).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got} == dict(enumerate(convs))

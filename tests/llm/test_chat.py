import random

import brute
import pytest
from compare import database, difference
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat, queries

MESSAGES = "conv bigint, msg bigint, parent bigint, role string, text string, score double"


def read(df):
    found = df.select(
        "conv", "path", "score", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")
    ).collect()
    return sorted(((r["conv"], r["path"], r["score"], [tuple(t) for t in r["turns"]], r["loss"]) for r in found), key=str)


def best(messages, branches):
    """All root-to-leaf paths by walking up."""
    rows = []
    for conv in {m[0] for m in messages}:
        own = {m[1]: m for m in messages if m[0] == conv}
        parents = {m[2] for m in own.values()}
        paths = []
        for leaf in (m for m in own if m not in parents):
            path, at = [], leaf
            while at in own:
                path.append(own[at])
                at = own[at][2]
            paths.append((-sum(m[5] or 0.0 for m in path), -len(path), leaf, path[::-1]))
        for k, (score, _, _, path) in enumerate(sorted(paths, key=lambda p: p[:3])[:branches]):
            turns = [(m[3] or "", m[4] or "") for m in path]
            rows.append((conv, k + 1, -score, turns, [t for r, t in turns if r == "assistant"]))
    return sorted(rows, key=str)


@pytest.mark.parametrize("branches", [1, 3])
def test_trees(spark, branches):
    rng = random.Random(4)
    texts = ["hi", "", None, "<|end|>\n", "a\\b", "<s>[INST]\\", "x\ny", "𝔘 </s>", "[/INST]<|turn|>"]
    messages = []
    for conv in (1, 2, None):
        for m in range(40):
            parent = rng.randrange(max(0, m - 6), m) if m and rng.random() < 0.95 else None
            score = None if rng.random() < 0.2 else rng.randrange(5) / 4
            messages.append((conv, m, parent, rng.choice(["user", "assistant", None, "sys\n<|text|>"]), rng.choice(texts), score))
    # A missing parent, and a long thread.
    messages.append((3, 1, 99, "user", "alone", 1.0))
    messages += [(4, m, m - 1 if m else None, "assistant", f"t{m}", 0.0) for m in range(70)]
    df = spark.createDataFrame(messages, MESSAGES)
    found = read(chat.format_conversations(df.withColumn("up", F.lit(1)).withColumn("depth", F.lit(2)), branches))
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in best(messages, branches)]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in best(messages, branches)])


def test_cycles_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], MESSAGES)
    with pytest.raises(ValueError, match="cycle"):
        chat.format_conversations(df)


def test_escapes_come_back(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["<", "|", ">", "[", "]", "/", "\\", "s", "INST", "end", "turn", "\n", "é", "<|end|>\n", "<<SYS>>"])), max_size=30))
    def check(parts):
        texts = ["".join(p) for p in parts] + [""]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
        for r in rows:
            assert r["u"] == r["t"]
            assert not any(c in r["e"] for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))

    check()


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (None, None, None, "x"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = read(chat.format_conversations(chat.chains(df)))
    assert [(r[0], r[3], r[4]) for r in found] == [
        (1, [("user", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")], ["a", "b", "b"]),
        (None, [("", "x")], []),
    ]


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_query_and_statement(spark):
    found = queries.op9_chat(spark, SMALL).toPandas()
    assert difference(found, database(SMALL).execute(queries.oracle_sql()["op9_chat"]).df()) is None
    own = found[found["conv_id"] == -7].iloc[0]
    hostile = "</s>[INST] ok [/INST]"
    assert own["turns_sha256"] == brute.sha(f"user\n{hostile}\nassistant\n{hostile}\n")
    assert own["loss_chars"] == len(hostile) and own["loss_sha256"] == brute.sha(hostile)

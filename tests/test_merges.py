"""Results that are merged from parts: scores in blocks, places in ranges, frequent ids, states in files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.config import IGNORE_LABEL
from corpusloom.operators import metrics as M
from corpusloom.operators import pooling as P
from corpusloom.operators import shards as H
from corpusloom.sources import state as ST

BLOCKS = "batch bigint, pos bigint, first int, logits array<double>, label int"


def cut(rows, sizes):
    """Rows (batch, pos, logits, label) in blocks of uneven sizes."""
    made = []
    for k, (batch, pos, logits, label) in enumerate(rows):
        at = 0
        while at < len(logits):
            n = sizes[(k + at) % len(sizes)]
            made.append((batch, pos, at, logits[at : at + n], label))
            at += n
    return made


@pytest.mark.parametrize("sizes", [[1], [3, 5, 2], [100]])
def test_blocks_equal_whole_rows(spark, sizes):
    rng = random.Random(2)
    rows = [
        (b, p, [rng.uniform(-3, 3) * 10 ** rng.randint(0, 3) for _ in range(17)], IGNORE_LABEL if rng.random() < 0.3 else rng.randrange(17))
        for b in range(5) for p in range(9)
    ]
    rows += [(9, p, [1.0, 2.0], IGNORE_LABEL) for p in range(3)] + [(10, 0, [5000.0, -5000.0], 1)]
    whole = spark.createDataFrame(rows, "batch bigint, pos bigint, logits array<double>, label int")
    blocks = spark.createDataFrame(cut(rows, sizes), BLOCKS).repartition(7)
    expected = {r["batch"]: r for r in M.masked_cross_entropy(whole, ["batch"]).collect()}
    found = {r["batch"]: r for r in M.masked_cross_entropy_blocks(blocks, ["batch"]).collect()}
    assert set(found) == set(expected)
    for b, r in found.items():
        assert math.isclose(r["loss"], expected[b]["loss"], rel_tol=1e-12) and r["num_masked"] == expected[b]["num_masked"]


def test_blocks_that_lack_something(spark):
    with pytest.raises(Exception, match="outside the logits"):
        M.masked_cross_entropy_blocks(spark.createDataFrame([(0, 0, 0, [1.0], 5)], BLOCKS), ["batch"]).collect()
    with pytest.raises(Exception, match="must not be null"):
        M.masked_cross_entropy_blocks(spark.createDataFrame([(0, 0, 0, None, 0)], BLOCKS), ["batch"]).collect()


def test_scores_are_not_shuffled(spark):
    plan = M.masked_cross_entropy_blocks(spark.createDataFrame([(0, 0, 0, [1.0], 0)], BLOCKS), ["batch"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert all("logits" not in line and "values" not in line for line in text.splitlines() if "Exchange" in line)


@pytest.mark.parametrize("seed", range(3))
def test_places_are_merged(spark, seed):
    rng = random.Random(seed)
    at, shards = rng.choice([0, 5]), []
    for i in range(60):
        n = rng.choice([0, 1, 7, 100])
        shards.append((i, at, at + n))
        at += n + rng.choice([0, 0, 3])
    catalog = spark.createDataFrame(shards, "shard_index int, token_start bigint, token_end bigint")
    # One place is a third of all rows; some lie before, between and after the shards, some are null.
    places = [rng.randint(-3, at + 3) for _ in range(300)] + [at // 2] * 150 + [None] * 3
    positions = spark.createDataFrame([(p, i, f"r{i}") for i, p in enumerate(places)], "position bigint, at bigint, shard string")
    inside = [(p, i, s, p - a) for i, p in enumerate(places) if p is not None for s, a, b in shards if a <= p < b]
    found = H.locate_merged(positions, catalog)
    assert found.columns == ["position", "at", "shard", "shard_index", "local_offset"]
    assert sorted((r[0], r[1], r[3], r[4]) for r in found.collect()) == sorted(inside)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_frequent_ids(spark):
    rows = [(0, i, 7 if i % 3 == 0 else 11 if i % 10 == 1 else 1000 + i) for i in range(6000)]
    at = spark.createDataFrame(rows, "seq_idx bigint, pos int, token_id int")
    found = P.frequent_ids(at)
    assert {7, 11} <= set(found) and len(found) < 600
    assert P.frequent_ids(at.where("false")) == []


def test_vectors_of_frequent_ids_are_sent(spark):
    """The vectors are exchanged once and as they are, however often an id occurs."""
    ids = [7] * 400 + list(range(200))
    samples = spark.createDataFrame([(s, ids) for s in range(4)], "seq_idx bigint, input_ids array<int>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "token_id int, vec array<double>")
    found = P.lookup_vectors(samples, vectors, max_broadcast_bytes=0)
    assert "Generate explode(" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 4 * 600 and all(r["vec"] == [float(r["token_id"]), 1.0] for r in rows)
    assert {(r["seq_idx"], r["pos"]) for r in rows} == {(s, p) for s in range(4) for p in range(600)}


def test_states_are_put_once(spark, tmp_path):
    store = ST.StateStore(spark, str(tmp_path / "states"))
    assert store.load(7, 30) is None and store.resume(7, 30) == ST.SamplerState(7, 30)
    state = ST.SamplerState(7, 30, 2)
    for step in (9, 10, 100):
        state = state.advance(3)
        store.save(step, state)
    (tmp_path / "states" / "step_900.tmp").write_text("x")
    assert store.steps() == [9, 10, 100]
    assert store.load(7, 30) == (100, ST.SamplerState(7, 30, 2, 9))
    assert store.load(7, 30, step=9) == (9, ST.SamplerState(7, 30, 2, 3))
    assert store.load(7, 30, step=11) is None
    with pytest.raises(ST.StepTaken, match="Step 10 "):
        store.save(10, state)
    assert store.load(7, 30, step=10)[1].index == 6
    with pytest.raises(ValueError, match="another seed"):
        store.load(8, 30)
    with pytest.raises(ValueError, match="another num_samples"):
        store.load(7, 31)
    with pytest.raises(ValueError, match="negative"):
        store.save(-1, state)

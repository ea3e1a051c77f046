import numpy as np
import pytest

from corpusloom.operators import pooling as P

RNG = np.random.default_rng(0)


@pytest.fixture
def vectors(spark):
    rows = [(i, [float(x) for x in RNG.normal(size=4)]) for i in range(20)]
    return spark.createDataFrame(rows, "token_id int, vec array<float>")


def pooled(df, key="seq_idx"):
    return {r[key]: r["pooled"] for r in df.collect()}


def test_masked_mean(spark):
    rows = [(s, RNG.normal(size=3).tolist(), int(m)) for s in range(50) for m in RNG.integers(0, 2, 9)]
    rows += [(99, [1.0, 2.0, 3.0], 0)] * 2
    df = spark.createDataFrame(rows, "seq_idx bigint, vec array<double>, mask int")
    found = pooled(P.masked_mean_pool(df, "seq_idx"))
    for key in {r[0] for r in rows}:
        mine = [(np.array(v), m) for s, v, m in rows if s == key]
        expected = sum(v * m for v, m in mine) / max(sum(m for _, m in mine), 1e-9)
        assert found[key] == pytest.approx(expected.tolist())
    assert found[99] == [0.0, 0.0, 0.0]


def test_plain_mean_of_a_frequent_key(spark):
    rows = [(0 if i % 3 else i, [float(i), 1.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, vec array<double>").repartition(6)
    found = pooled(P.mean_pool(df, "k"), "k")
    hot = [v for k, v in rows if k == 0]
    assert found[0] == pytest.approx(np.mean(hot, axis=0).tolist())
    assert found[3] == [3.0, 1.0] and len(found) == 1000


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0])], "k bigint, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="same length"):
        P.mean_pool(df, "k").collect()


@pytest.mark.parametrize("limit", [P.MAX_BROADCAST_BYTES, 0])
def test_lookup(spark, vectors, limit):
    df = spark.createDataFrame([(0, [1, 2, 2]), (1, [2] * 50 + [7])], "seq_idx bigint, input_ids array<int>")
    known = {r["token_id"]: r["vec"] for r in vectors.collect()}
    found = P.lookup_vectors(df, vectors, max_broadcast_bytes=limit).collect()
    assert len(found) == 54
    by_place = {(r["seq_idx"], r["pos"]): r for r in found}
    assert by_place[0, 0]["token_id"] == 1 and by_place[1, 50]["token_id"] == 7
    assert all(r["vec"] == known[r["token_id"]] for r in found)


@pytest.mark.parametrize("limit", [P.MAX_BROADCAST_BYTES, 0])
def test_embed_sequences(spark, vectors, limit, monkeypatch):
    """Padding doesn't change a vector; both ways of looking vectors up agree."""
    monkeypatch.setattr(P, "POSITIONS_AT_ONCE", 3)
    known = {r["token_id"]: np.array(r["vec"]) for r in vectors.collect()}
    rows = [(0, [5, 6, 7, 8]), (1, [5, 6, 7, 8, 1, 1, 1, 1]), (2, [1, 1]), (3, [4] * 7 + [9]), (4, [1, 3]), (5, [])]
    df = spark.createDataFrame(rows, "seq_idx bigint, input_ids array<int>")
    found = pooled(P.embed_sequences(df, vectors, pad_id=1, max_broadcast_bytes=limit))
    for key, ids in rows:
        used = [known[i] for i in ids if i != 1]
        assert found[key] == pytest.approx(np.mean(used, axis=0).tolist() if used else [0.0] * 4)


@pytest.mark.parametrize("limit", [P.MAX_BROADCAST_BYTES, 0])
def test_both_sides_of_the_limit(spark, limit):
    """Padding without a vector, doubles beyond float precision, unknown ids, repeated ids."""
    vectors = spark.createDataFrame([(2, [0.55, 1 / 3]), (3, [0.1, 0.2])], "token_id int, vec array<double>")
    rows = [(0, [2, 2, 2]), (1, [1, 1]), (2, []), (3, [3, 1, 2])]
    samples = spark.createDataFrame(rows, "seq_idx bigint, input_ids array<int>")
    found = pooled(P.embed_sequences(samples, vectors, 1, max_broadcast_bytes=limit))
    assert found[0] == pytest.approx([0.55, 1 / 3], rel=1e-14) and found[3] == pytest.approx([0.325, 8 / 30], rel=1e-14)
    assert found[1] == found[2] == [0.0, 0.0] and len(found) == 4
    unknown = spark.createDataFrame([(0, [2, 9])], "seq_idx bigint, input_ids array<int>")
    with pytest.raises(Exception, match="No vector for token 9"):
        P.embed_sequences(unknown, vectors, 1, max_broadcast_bytes=limit).collect()
    with pytest.raises(Exception, match="No vector for token 9"):
        P.lookup_vectors(unknown, vectors, max_broadcast_bytes=limit).collect()
    with pytest.raises(ValueError, match="one row per id"):
        P.embed_sequences(samples, vectors.unionByName(vectors), 1, max_broadcast_bytes=limit)


def test_sums_go_on_over_batches(spark):
    """Partial sums of a key that fill several Arrow batches meet again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k, [float(i), 1.0]) for k in (None, "a", "b") for i in range(20)]
        df = spark.createDataFrame(rows, "k string, vec array<double>").repartition(3)
        assert pooled(P.mean_pool(df, "k"), "k") == {k: [9.5, 1.0] for k in (None, "a", "b")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_users_encoder(spark):
    rows = [(i, [i, i + 1], [1, 0]) for i in range(5)]
    df = spark.createDataFrame(rows, "seq_idx bigint, input_ids array<int>, attention_mask array<int>")

    def encoder():
        return lambda ids, masks: np.array([[float(np.dot(i, m)), len(i)] for i, m in zip(ids, masks)])

    assert pooled(P.encode_with(df, encoder)) == {i: [float(i), 2.0] for i in range(5)}

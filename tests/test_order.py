import pytest
from pyspark.sql import functions as F

from corpusloom.config import LoaderConfig
from corpusloom.operators import order as R
from corpusloom.plans import loading
from corpusloom.sources import state as ST


def sequence(df, col="seq_idx", pos="pos"):
    rows = sorted(df.collect(), key=lambda r: r[pos])
    assert [r[pos] for r in rows] == sorted({r[pos] for r in rows})
    return [r[col] for r in rows]


@pytest.mark.parametrize("hash_fn", ["xxhash64", "md5"])
@pytest.mark.parametrize("n", [0, 1, 10, 100, 1000])
def test_permutation(spark, n, hash_fn, monkeypatch):
    whole = sequence(R.permutation(spark, n, 42, 0, hash_fn))
    assert sorted(whole) == list(range(n))
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 7)
    assert sequence(R.permutation(spark, n, 42, 0, hash_fn)) == whole


def test_samples_take_their_columns_along(spark, monkeypatch):
    monkeypatch.setattr(R, "SAMPLES_PER_BUCKET", 9)
    samples = spark.range(100).selectExpr("id AS seq_idx", "array(id, 2 * id) AS input_ids").repartition(7)
    found = R.permute(samples, 100, 42, 1, partitions=5)
    assert sequence(found) == sequence(R.permutation(spark, 100, 42, 1))
    assert all(r["input_ids"] == [r["seq_idx"], 2 * r["seq_idx"]] for r in found.collect())


def test_permutation_depends_on_seed_plus_epoch(spark):
    first = sequence(R.permutation(spark, 50, 0, 1))
    assert first == sequence(R.permutation(spark, 50, 1, 0))
    assert first != sequence(R.permutation(spark, 50, 0, 0)) != list(range(50))
    assert sequence(R.sequential(spark, 50)) == list(range(50))


def test_permutation_is_even(spark):
    """Ranks of the first half of the samples are spread over the whole epoch."""
    ranks = [r["pos"] for r in R.permutation(spark, 20000, 3, 0).where("seq_idx < 10000").collect()]
    assert abs(sum(ranks) / len(ranks) - 10000) < 200


def test_unknown_hash(spark):
    with pytest.raises(ValueError, match="md5"):
        R.permutation(spark, 5, 0, 0, "crc")


def test_resume_equals_straight_run(spark):
    straight = sequence(R.permutation(spark, 30, 7, 2))
    state = ST.SamplerState(seed=7, num_samples=30, epoch=2)
    for _ in range(3):
        state = state.advance(3)
    order = R.permutation(spark, state.num_samples, state.seed, state.epoch)
    assert sequence(R.resume(order, state.index)) == straight[9:]
    assert sequence(R.resume(order, state.index)) == straight[9:]
    assert state.next_epoch() == ST.SamplerState(7, 30, 3, 0)


@pytest.mark.parametrize("n", [10, 2, 1, 12])
@pytest.mark.parametrize("world", [1, 3, 4, 16])
@pytest.mark.parametrize("drop_last", [True, False])
def test_ranks(spark, n, world, drop_last):
    order = R.permutation(spark, n, 1, 0)
    indices = sequence(order)
    if drop_last:
        indices = indices[: n // world * world]
    else:
        total = -(-n // world) * world
        indices = (indices * (total // n + 1))[:total]
    stripes = R.rank_stripes(order, n, world, drop_last).collect()
    for rank in range(world):
        mine = sorted((r["local_pos"], r["seq_idx"]) for r in stripes if r["rank"] == rank)
        assert [s for _, s in mine] == indices[rank::world]
        assert [p for p, _ in mine] == list(range(len(mine)))


@pytest.mark.parametrize("drop_last", [True, False])
@pytest.mark.parametrize("n,size", [(10, 4), (8, 4), (3, 4), (0, 4)])
def test_batches(spark, n, size, drop_last):
    rows = R.batches(R.sequential(spark, n), n, size, drop_last).collect()
    expected = [(i // size, i % size) for i in range(n)]
    if drop_last:
        expected = expected[: n // size * size]
    assert sorted((r["batch_id"], r["pos_in_batch"]) for r in rows) == expected


@pytest.mark.parametrize("drop_last", [True, False])
@pytest.mark.parametrize("world,index", [(1, 0), (1, 9), (3, 5)])
def test_loader_order(spark, world, index, drop_last):
    """Batches are made of what is left after the index, rank by rank."""
    n, size = 41, 4
    left = sequence(R.permutation(spark, n, 5, 1))[index:]
    config = LoaderConfig(size, drop_last=drop_last, world_size=world)
    rows = loading.sample_order(spark, n, config, 5, 1, index).collect()
    found = {(r["rank"], r["batch_id"], r["pos_in_batch"]): r["seq_idx"] for r in rows}
    even = len(left) // world * world if drop_last else -(-len(left) // world) * world
    if world > 1 or not drop_last:
        left = (left + left)[:even]
    expected = {}
    for rank in range(world):
        mine = left[rank::world]
        mine = mine[: len(mine) // size * size] if drop_last else mine
        expected |= {(rank, i // size, i % size): s for i, s in enumerate(mine)}
    assert found == expected


def test_order_changes_with_epoch_only_when_shuffled(spark):
    for shuffle in (True, False):
        config = LoaderConfig(4, shuffle=shuffle)
        first, second = (
            [tuple(r) for r in loading.sample_order(spark, 16, config, 0, e).drop("epoch").orderBy("pos").collect()]
            for e in (0, 1)
        )
        assert (first == second) is not shuffle


def test_loader_config():
    with pytest.raises(ValueError, match="batch_size"):
        LoaderConfig(0)
    with pytest.raises(ValueError, match="world_size"):
        LoaderConfig(world_size=0)


def test_state_is_saved_and_restored(spark, tmp_path):
    path = str(tmp_path / "states")
    assert ST.load_state(spark, path, 7, 30) is None
    for step in (9, 10, 2):
        ST.save_state(spark, path, step, ST.SamplerState(7, 30, epoch=step // 4, index=step))
    assert ST.load_state(spark, path, 7, 30) == (10, ST.SamplerState(7, 30, 2, 10))
    with pytest.raises(ValueError, match="seed"):
        ST.load_state(spark, path, 8, 30)
    with pytest.raises(ValueError, match="num_samples"):
        ST.load_state(spark, path, 7, 31)


def test_latest_state_compares_numbers(spark):
    names = [(1, "step_9.pt"), (1, "step_10.pt"), (1, "other"), (1, "step_99.pt.tmp"), (1, "xstep_77.pt"), (2, "step_x.pt")]
    found = ST.latest_states(spark.createDataFrame(names, "run int, name string"), ["run"])
    assert sorted(map(tuple, found.collect())) == [(1, 10, "step_10.pt"), (2, None, None)]


def test_draws_are_those_of_xxhash(spark):
    xxhash = pytest.importorskip("xxhash")
    from corpusloom.functions.draws import draw

    def expected(*keys):
        h = 42
        for k in keys:
            h = xxhash.xxh64(k.to_bytes(8, "little", signed=True), seed=h).intdigest()
        return h >> 32

    rows = spark.range(20).select("id", draw("xxhash64", 2, 7, F.col("id"), 5).alias("u")).collect()
    assert [r["u"] for r in rows] == [expected(2, 7, r["id"], 5) for r in rows]

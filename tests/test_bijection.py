import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.config import HEADER_BYTES, LoaderConfig, TokenIdentity, WindowConfig, mlm_config
from corpusloom.operators.bijection import Bijection, sides
from corpusloom.plans import loading
from corpusloom.sources import token_shards as TS


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**40), st.integers(0, 50))
def test_it_is_a_bijection(n, seed, epoch):
    order = Bijection(n, seed, epoch)
    places = order.positions(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert order.samples(places).tolist() == list(range(n))


@given(st.integers(0, 10**13))
@settings(max_examples=40, deadline=None)
def test_few_numbers_are_walked_over(n):
    a, b = sides(n)
    assert n <= a * b <= max(n + 16, 1)


def test_large_numbers_go_there_and_back():
    n = 700_000_000_000
    order, some = Bijection(n, 1, 2), np.random.default_rng(0).integers(0, 700_000_000_000, 1000)
    places = order.positions(some)
    assert (order.samples(places) == some).all() and places.min() >= 0 and places.max() < n
    assert len(np.unique(places)) == len(np.unique(some))


def test_order_is_even_and_changes():
    n = 40_000
    first, other = (Bijection(n, 3, e).positions(np.arange(n)) for e in (0, 1))
    for part in (first[: n // 2], first[::2], first[first < n // 2]):
        assert abs(part.mean() - (n / 2 if part.max() > n // 2 else n / 4)) < n / 100
    steps = np.diff(first)
    assert abs(np.corrcoef(first[:-1], first[1:])[0, 1]) < 0.02 and len(np.unique(steps)) > n // 3
    assert (first == other).mean() < 0.001
    assert (Bijection(n, 2, 1).positions(np.arange(n)) == first).all()


@pytest.mark.parametrize("hash_fn", ["xxhash64", "md5"])
@pytest.mark.parametrize("n", [1, 2, 60, 1009])
def test_columns_and_arrays_agree(spark, n, hash_fn):
    order = Bijection(n, 2**35, 4, hash_fn)
    ids = spark.range(n)
    found = ids.select("id", order.position(F.col("id")).alias("pos"), order.sample(F.col("id")).alias("back")).toPandas()
    assert (found["pos"].to_numpy() == order.positions(found["id"].to_numpy())).all()
    assert (found["back"].to_numpy() == order.samples(found["id"].to_numpy())).all()


def test_bad_arguments():
    with pytest.raises(ValueError, match="negative"):
        Bijection(-1, 0, 0)
    with pytest.raises(ValueError, match="md5"):
        Bijection(5, 0, 0, "crc")
    with pytest.raises(ValueError, match="keyed"):
        LoaderConfig(order="sorted")


@pytest.fixture
def folder(tmp_path, shard_file):
    """Three shards that windows cross; token i of the split's stream is i."""
    at = 0
    for i, n in enumerate((700, 5, 1900)):
        shard_file(tmp_path, f"fineweb_train_{i:06d}.bin", range(at, at + n))
        at += n
    return str(tmp_path)


class Counting:
    """Counts the bytes of tokens that are read."""

    def __init__(self):
        self.real, self.read = pafs.LocalFileSystem(), 0

    def __getattr__(self, name):
        return getattr(self.real, name)

    def open_input_file(self, path):
        outer, real = self, self.real.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *error):
                real.close()

            def read(self, n):
                return real.read(n)

            def read_at(self, n, at):
                assert at >= HEADER_BYTES
                outer.read += n
                return real.read_at(n, at)

        return File()


def test_a_resume_reads_only_its_share(folder, monkeypatch):
    counting = Counting()
    monkeypatch.setattr(TS, "filesystem", lambda path: (counting, path))
    options = {"path": folder, "split": "train", "mode": "ordered", "seqLength": "10", "orderSeed": "5", "partitionTokens": "700"}
    n, found = 260, []
    for index in (0, 130, 234, 260):
        reader, counting.read = TS.ShardReader(options), 0
        list(reader.pushFilters([TS.GreaterThanOrEqual(("pos",), index)]))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert counting.read == 2 * 10 * (n - index)
        assert sorted(r["pos"] for r in rows) == list(range(index, n))
        assert all(r["input_ids"] == list(range(10 * r["seq_idx"], 10 * r["seq_idx"] + 10)) for r in rows)
        found.append({(r["pos"], r["seq_idx"]) for r in rows})
    assert found[2] < found[1] < found[0]


def test_resumed_batches_equal_the_straight_run(spark, folder):
    """As after three batches: what is left comes in the same order, and nothing is exchanged."""
    identity = TokenIdentity(vocab_size=50265, mask_id=103)
    loader = LoaderConfig(3, order="keyed")
    args = (spark, folder, "train", "mlm", mlm_config(identity, seed=1), WindowConfig(20), loader)
    straight = loading.training_batches(*args, seed=7, epoch=2)
    resumed = loading.training_batches(*args, seed=7, epoch=2, index=9)
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    later = {(r["batch_id"] - 3, r["pos_in_batch"]): (r["seq_idx"], r["labels"]) for r in straight.where("batch_id >= 3").collect()}
    assert {(r["batch_id"], r["pos_in_batch"]): (r["seq_idx"], r["labels"]) for r in resumed.collect()} == later
    order = loading.sample_order(spark, 130, loader, 7, 2, 9).collect()
    assert {(r["batch_id"], r["pos_in_batch"]): r["seq_idx"] for r in order} == {k: v[0] for k, v in later.items()}

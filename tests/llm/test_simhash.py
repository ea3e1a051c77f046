import random

import brute
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.llm import queries, simhash
from corpusloom.llm.components import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(a, rng, bits):
    return a ^ sum(1 << b for b in rng.sample(range(64), bits))


@pytest.fixture
def crowd():
    """Chains and clouds of near fingerprints among random ones, and some that share most bits."""
    rng = random.Random(3)
    made = [rng.getrandbits(64) for _ in range(150)]
    for base in list(made[:20]):
        for _ in range(5):
            base = near(base, rng, rng.randint(1, 5))
            made.append(base)
    made += [near(made[0], rng, rng.randint(0, 7)) for _ in range(80)]
    made += [rng.getrandbits(12) for _ in range(80)] + [0]
    return sorted(set(made))


@pytest.mark.parametrize("cell", [simhash.CELL, 3])
def test_classes(spark, crowd, cell):
    rows = spark.createDataFrame([(signed(x),) for x in crowd], "fp bigint")
    found = {r["fp"]: r["root"] for r in simhash.classes(rows, cell=cell).collect()}
    wanted = brute.near_components(crowd)
    by_root, by_class = {}, {}
    for x, c in zip(crowd, wanted):
        assert by_root.setdefault(found[signed(x)], c) == c
        assert by_class.setdefault(c, found[signed(x)]) == found[signed(x)]


@pytest.mark.parametrize("n", [100, 10**6, 10**10])
def test_design_misses_no_pair(n):
    """Any two fingerprints within the distance agree, within the units, in some partition."""
    rng = random.Random(n)
    sample = np.array([rng.getrandbits(64) & ~(rng.getrandbits(1) * 0xFFFF) for _ in range(300)], np.uint64)
    partitions = simhash.design(sample, n)
    assert sum(p.units for p in partitions) == simhash.DISTANCE + 1
    assert len({b for p in partitions for b in p.bits}) == sum(len(p.bits) for p in partitions)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = near(a, rng, rng.randint(0, simhash.DISTANCE))
        assert any(((a ^ b) & p.mask).bit_count() < p.units for p in partitions)


def test_design_follows_size():
    rng = random.Random(1)
    sample = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    small, large = simhash.design(sample, 10**4), simhash.design(sample, 10**9)
    assert len(small) > len(large) and {p.units for p in large} != {1}


def test_correlated_bits_stay_together():
    rng = random.Random(2)
    twin = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(400)]
    # Bits 0 to 7 repeat bit 40.
    sample = np.array([(a << 32 | b) & ~0xFF | (0xFF * (a >> 8 & 1)) for a, b in twin], np.uint64)
    groups = simhash.group_bits(sample, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({*range(8), 40} <= set(g) for g in groups)


def expected(rows):
    prints = [brute.fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    least = brute.smallest_ids(ids, brute.near_components(prints))
    return sorted(zip(ids, prints, least), key=str)


def test_odd_rows(odd, odd_rows, clashing):
    found = simhash.near_duplicates(clashing(odd)).collect()
    rows = sorted(((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in found), key=str)
    assert rows == expected([(r[0], r[1]) for r in odd_rows])


def test_keeps_one_of_each(odd, odd_rows, clashing):
    docs = clashing(odd)
    left = simhash.keep_first(docs)
    assert left.columns == docs.columns
    least = {x for _, _, x in expected([(r[0], r[1]) for r in odd_rows])}
    kept = [r["doc_id"] for r in left.collect()]
    assert set(kept) == least and len(kept) == len(least) + (kept.count(5) - 1 if 5 in kept else 0)


def test_null_ids_only(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "x y z u v w")], "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {None}
    assert sorted(r["text"] for r in simhash.keep_first(docs).collect()) == ["a b c d e f", "x y z u v w"]


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    loops = [(5000, 5000), (6001, 6000), (6000, 6001)]
    df = spark.createDataFrame(chain + star + loops, "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(df).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 60)} | {6001: 6000}


def test_query(spark, texts):
    found = queries.op10_simhash(spark, SMALL).select("doc_id", F.col("fingerprint"), "component_id")
    rows = sorted(((r[0], int(r[1], 16), r[2]) for r in found.collect()), key=str)
    assert rows == expected([(i, t) for i, t, _ in texts])
    assert all(len(r["fingerprint"]) == 16 for r in found.collect())


@pytest.mark.parametrize("distance", [1, 3])
def test_odd_distances_with_crowded_cells(spark, distance):
    """Cells of any size link the same pairs, of odd distances too."""
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**62), 2**62, 6)
    prints = {int(b) ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)}
    rows = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    found = [{(r["fp"], r["root"]) for r in simhash.classes(rows, distance, cell=cell).collect()} for cell in (2048, 4)]
    assert found[0] == found[1] and len({root for _, root in found[0]}) < len(prints)


def test_big_components_are_sent(spark, odd, monkeypatch):
    whole = sorted(map(str, simhash.near_duplicates(odd).collect()))
    monkeypatch.setattr(simhash, "BIG", 0)
    monkeypatch.setattr(simhash, "MAX_BIG", 10**6)
    assert sorted(map(str, simhash.near_duplicates(odd).collect())) == whole


def test_the_row_that_stays_is_always_the_same(spark):
    """Rows that agree in id and text but not in the rest."""
    rows = [(1, "one two three four five", f"l{i}", f"s{i % 3}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {tuple(simhash.keep_first(docs.repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(kept) == 1

from collections import defaultdict

import brute
import pytest
from conftest import SMALL

from corpusloom.llm import queries, sharding


def check(found, docs, shards):
    """Every row once; contiguous in id order, gapless slots, sizes within the largest row of the target."""
    assert sorted(((r["key"], r["size"], r["crc"]) for r in found), key=str) == sorted(brute.sizes(docs), key=str)
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["key"] is not None, r["key"] or 0) for r in order]
    assert keys == sorted(keys)
    by_shard = defaultdict(list)
    for r in order:
        by_shard[r["shard"]].append(r)
    assert all([r["slot"] for r in rows] == list(range(len(rows))) for rows in by_shard.values())
    assert all(0 <= s < shards for s in by_shard)
    target = sum(r["size"] for r in found) / shards
    largest = max(r["size"] for r in found)
    assert all(abs(sum(r["size"] for r in by_shard[s]) - target) <= largest for s in range(shards))


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows(odd, odd_rows, shards):
    check(sharding.assign_shards(odd, shards).collect(), [(r[0], r[1]) for r in odd_rows], shards)


def test_many_equal_rows(spark):
    rows = [(1, "same")] * 500 + [(2, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    check(sharding.assign_shards(docs, 7).collect(), rows, 7)


def test_empty_and_bounds(empty, odd):
    assert sharding.assign_shards(empty, 5).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(odd, 0)


def test_files_hold_whole_rows(spark, odd, clashing, tmp_path):
    docs = clashing(odd).drop("shard")
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, 4, path)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*docs.columns, "shard"}
    assert sorted(map(str, back.select("doc_id", "text", "source").collect())) == sorted(
        map(str, docs.select("doc_id", "text", "source").collect())
    )


def test_query(spark, texts):
    found = queries.op2_sharding(spark, SMALL)
    rows = [r.asDict() | {"key": r["doc_id"], "crc": r["text_crc32"]} for r in found.collect()]
    check(rows, [(i, t) for i, t, _ in texts], queries.SHARDS)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_an_own_column_named_shard_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i, -i) for i in range(9)], "doc_id bigint, text string, Shard int")
    with pytest.raises(ValueError, match="folder_col"):
        sharding.write_shards(docs, 3, str(tmp_path / "a"))
    sharding.write_shards(docs, 3, str(tmp_path / "b"), folder_col="part")
    found = spark.read.parquet(str(tmp_path / "b"))
    assert sorted((r["doc_id"], r["Shard"]) for r in found.collect()) == [(i, -i) for i in range(9)]
    assert {r["part"] for r in found.collect()} == {0, 1, 2}

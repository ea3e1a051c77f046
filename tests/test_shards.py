import numpy as np
import pytest

from corpusloom.config import TokenIdentity, WindowConfig
from corpusloom.operators import shards as H
from corpusloom.operators import stream as S
from corpusloom.plans import loading
from corpusloom.sources import token_shards as TS


def windows(spark, folder, length, epoch=0, strategy="fixed", split="train", **options):
    df = TS.read_windows(spark, str(folder), split, WindowConfig(length, strategy), epoch, **options)
    return {r["seq_idx"]: r["input_ids"] for r in df.collect()}


def expected(stream, length, offset=0):
    count = max(len(stream) - offset, 0) // length
    return {i: list(stream[offset + i * length : offset + (i + 1) * length]) for i in range(count)}


@pytest.fixture
def unaligned(tmp_path, shard_file):
    """700 + 5 + 0 + 900 tokens: windows of 512 cross two and three shards, and an empty one."""
    stream = np.random.default_rng(1).integers(100, 50265, 1605).tolist()
    for i, (a, b) in enumerate([(0, 700), (700, 705), (705, 705), (705, 1605)]):
        shard_file(tmp_path, f"fineweb_train_{i:06d}.bin", stream[a:b])
    shard_file(tmp_path, "fineweb_val_000009.bin", [7] * 600)
    return tmp_path, stream


@pytest.mark.parametrize("length", [512, 100, 7, 3])
@pytest.mark.parametrize("epoch", [0, 1, 3])
def test_windows_across_shards(spark, unaligned, length, epoch):
    folder, stream = unaligned
    offset = WindowConfig(length, "epoch_offset").offset(epoch)
    found = windows(spark, folder, length, epoch, "epoch_offset", partitionTokens=300)
    assert found == expected(stream, length, offset)


def test_windows_of_one_split(spark, unaligned):
    folder, _ = unaligned
    assert windows(spark, folder, 512, split="val") == {0: [7] * 512}


def test_window_range(spark, unaligned):
    folder, stream = unaligned
    found = windows(spark, folder, 100, firstWindow=3, lastWindow=9, partitionTokens=200)
    assert found == {i: w for i, w in expected(stream, 100).items() if 3 <= i < 9}


def test_lookup(spark, unaligned):
    folder, stream = unaligned
    config = WindowConfig(100, "epoch_offset")
    for i in (0, 6, 7, 14):
        row = loading.shard_window(spark, str(folder), "train", config, i, epoch=2).collect()
        assert [(r["seq_idx"], r["input_ids"]) for r in row] == [(i, expected(stream, 100, 50)[i])]
    for i in (-1, 15):
        with pytest.raises(IndexError):
            loading.shard_window(spark, str(folder), "train", config, i, epoch=2)


def test_windows_longer_than_stream(spark, unaligned):
    assert windows(spark, unaligned[0], 5000) == {}


def test_chunks_agree_with_windows(spark, unaligned):
    folder, stream = unaligned
    chunks = TS.read_tokens(spark, str(folder), "train", chunkTokens=64, partitionTokens=128)
    placed = chunks.selectExpr("split_start AS start", "tokens")
    found = {r["seq_idx"]: r["input_ids"] for r in S.windows_from_chunks(placed, 100).collect()}
    assert found == expected(stream, 100)


def test_filters_prune_files_and_windows(spark, unaligned):
    """Comparisons of the split, the shard number and the window index reach the reader."""
    folder, stream = unaligned
    tokens = TS.read_tokens(spark, str(folder), chunkTokens=64, partitionTokens=64)
    val = tokens.where("split = 'val'")
    assert val.rdd.getNumPartitions() == 10 and val.where("split_start != start").count() == 0
    third = tokens.where("shard_index >= 3 AND shard_index < 9")
    assert third.rdd.getNumPartitions() == 15 and third.selectExpr("min(split_start)").first()[0] == 705
    assert tokens.where("shard_index IN (1, 2)").rdd.getNumPartitions() == 1
    assert tokens.where("split = 'none'").count() == 0
    headers = TS.read_headers(spark, str(folder)).where("split = 'val'")
    assert [r["name"] for r in headers.collect()] == ["fineweb_val_000009.bin"]
    every = TS.read_windows(spark, str(folder), "train", WindowConfig(100), partitionTokens=100)
    some = every.where("seq_idx > 2 AND seq_idx <= 4 OR seq_idx = 3").where("seq_idx >= 3")
    assert {r["seq_idx"]: r["input_ids"] for r in some.collect()} == {i: stream[100 * i : 100 * i + 100] for i in (3, 4)}
    assert every.where("seq_idx = 7").rdd.getNumPartitions() == 1
    assert every.where("seq_idx < 0").count() == 0 and every.where("seq_idx = 99").count() == 0


def test_shards_must_be_numbered_in_a_row(spark, tmp_path, shard_file):
    shard_file(tmp_path, "fineweb_train_000000.bin", range(100, 164))
    shard_file(tmp_path, "fineweb_train_000002.bin", range(100, 164))
    with pytest.raises(Exception, match="numbered in a row"):
        windows(spark, tmp_path, 8)


def test_other_names_are_no_shards(spark, tmp_path, shard_file):
    shard_file(tmp_path, "fineweb_train_000000.bin", range(100, 164))
    shard_file(tmp_path, "fineweb_train_last.bin", range(100, 164))
    assert [s.name for s in TS.list_shards(str(tmp_path))] == ["fineweb_train_000000.bin"]


@pytest.mark.parametrize(
    "path,place",
    [("/a/b", "/a/b"), ("file:/a/b", "/a/b"), ("file:///a/b", "/a/b"), ("dbfs:/a/b", "/dbfs/a/b"), ("a/b", "a/b")],
)
def test_local_paths(path, place):
    assert TS.filesystem(path)[1] == place


def test_paths_are_those_of_spark(spark):
    assert TS.qualified(spark, "/a/b") == "file:/a/b"
    assert TS.qualified(spark, "file:///a/b").startswith("file:/")


def test_catalog(spark, unaligned):
    folder, _ = unaligned
    rows = H.open_shards(spark, str(folder), "train").orderBy("name").collect()
    assert [(r["token_start"], r["token_end"]) for r in rows] == [(0, 700), (700, 705), (705, 705), (705, 1605)]
    rows = H.split_totals(TS.read_headers(spark, str(folder))).collect()
    totals = {r["split"]: (r["num_shards"], r["total_tokens"]) for r in rows}
    assert totals == {"train": (4, 1605), "val": (1, 600)}


@pytest.mark.parametrize("shipped", [H.MAX_SHIPPED_SHARDS, 2, 1])
def test_locate(spark, unaligned, monkeypatch, shipped):
    monkeypatch.setattr(H, "MAX_SHIPPED_SHARDS", shipped)
    catalog = H.open_shards(spark, str(unaligned[0]), "train")
    positions = spark.createDataFrame([(p,) for p in (0, 699, 700, 704, 705, 1604, 1605, -1)], "position bigint")
    found = {tuple(r) for r in H.locate(positions, catalog).collect()}
    assert found == {(0, 0, 0), (699, 0, 699), (700, 1, 0), (704, 1, 4), (705, 3, 0), (1604, 3, 899)}


def test_missing_folder_and_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="not found"):
        TS.read_windows(spark, str(tmp_path / "none"), "train", WindowConfig(8))
    with pytest.raises(FileNotFoundError, match="No shards"):
        TS.read_windows(spark, str(tmp_path), "train", WindowConfig(8))


@pytest.mark.parametrize(
    "wrong,message",
    [({"magic": 99999}, "magic"), ({"version": 99}, "version"), ({"count": 1024}, "file size")],
)
def test_bad_headers(spark, tmp_path, shard_file, wrong, message):
    shard_file(tmp_path, "fineweb_train_000000.bin", range(100, 612), **wrong)
    with pytest.raises(Exception, match=message):
        TS.read_headers(spark, str(tmp_path), "train").collect()
    with pytest.raises(Exception, match=message):
        windows(spark, tmp_path, 64)


@pytest.mark.parametrize("field", ["vocab", "pad", "cls", "sep", "mask"])
def test_inconsistent_headers(spark, tmp_path, shard_file, field):
    shard_file(tmp_path, "fineweb_train_000000.bin", range(100, 164))
    shard_file(tmp_path, "fineweb_train_000001.bin", range(100, 200), **{field: 77})
    with pytest.raises(ValueError, match=f"{field}.* isn't the same.*000001.bin"):
        H.open_shards(spark, str(tmp_path), "train")


def test_vocabulary_check(spark, tmp_path, shard_file):
    shard_file(tmp_path, "fineweb_train_000000.bin", range(100, 164), mask=50264, cls=9)
    H.open_shards(spark, str(tmp_path), "train", TokenIdentity(50265))
    with pytest.raises(ValueError, match="mask_id"):
        H.open_shards(spark, str(tmp_path), "train", TokenIdentity(50265, mask_id=4))
    with pytest.raises(ValueError, match="vocab_size"):
        H.open_shards(spark, str(tmp_path), "train", TokenIdentity(50266, mask_id=50264))


def test_written_bytes(spark, doc_tokens, tmp_path, identity):
    """The files hold the header and tokens exactly as the format says."""
    lengths = [60, 3, 90, 47]
    pieces = S.stream_offsets(doc_tokens(lengths))
    folder = tmp_path / "new" / "shards"
    TS.write_shards(S.shard_pieces(pieces, 64, 200, val_shards=1), str(folder), identity)
    names = {p.name for p in folder.iterdir()}
    assert names == {"fineweb_val_000000.bin", *(f"fineweb_train_{i:06d}.bin" for i in (1, 2, 3))}
    stream = np.arange(100, 300)
    for i in range(4):
        raw = (folder / f"fineweb_{'val' if i == 0 else 'train'}_{i:06d}.bin").read_bytes()
        tokens = stream[64 * i : 64 * (i + 1)]
        header = np.frombuffer(raw[:1024], "<i4")
        assert header[:8].tolist() == [20240520, 3, len(tokens), 50265, 1, 0, 2, 50264]
        assert not header[8:].any()
        assert np.frombuffer(raw[1024:], "<u2").tolist() == tokens.tolist()


def test_overwrite(spark, doc_tokens, tmp_path, identity):
    folder = str(tmp_path / "s")
    for lengths, mode in (([200], "append"), ([70], "overwrite")):
        pieces = S.stream_offsets(doc_tokens(lengths))
        TS.write_shards(S.shard_pieces(pieces, 64, sum(lengths)), folder, identity, mode=mode)
    assert [s.name for s in TS.list_shards(folder)] == [f"fineweb_train_{i:06d}.bin" for i in (0, 1)]


def test_tokens_out_of_range_are_refused(spark, doc_tokens, tmp_path, identity):
    pieces = S.stream_offsets(doc_tokens([10], first_id=65530))
    with pytest.raises(Exception, match="uint16"):
        TS.write_shards(S.shard_pieces(pieces, 64, 10), str(tmp_path / "s"), identity)
    left = list((tmp_path / "s").iterdir()) if (tmp_path / "s").exists() else []
    assert left == []


def test_missing_tokens_are_refused(spark, doc_tokens, tmp_path, identity):
    cut = S.shard_pieces(S.stream_offsets(doc_tokens([10, 10, 10])), 30, 30)
    with pytest.raises(Exception, match="lacks tokens"):
        TS.write_shards(cut.where("start != 10"), str(tmp_path / "s"), identity)
    with pytest.raises(Exception, match="of its 30 tokens"):
        TS.write_shards(cut.where("start < 20"), str(tmp_path / "s"), identity)

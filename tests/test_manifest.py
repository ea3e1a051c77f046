import json
import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from corpusloom.config import WindowConfig
from corpusloom.operators import stream as S
from corpusloom.sources import manifest as MF
from corpusloom.sources import shard_stream as SS
from corpusloom.sources import token_shards as TS

LOCAL = pafs.LocalFileSystem()


class Dying:
    """A file system that stops working after so many changes, as a lost driver does."""

    def __init__(self, changes):
        self.left, self.type_name = changes, "local"

    def __getattr__(self, name):
        real = getattr(LOCAL, name)
        if name not in ("move", "delete_file", "delete_dir", "create_dir", "open_output_stream"):
            return real

        def call(*args, **kwargs):
            if not self.left:
                raise RuntimeError("the driver is gone")
            self.left -= 1
            return real(*args, **kwargs)

        return call


def staged(folder, names, token, overwrite=False, **options):
    """A writer whose tasks are done, and their messages; a shard of ``name`` holds 4 times ``token``."""
    ids = dict.fromkeys(("vocab_size", "pad_id", "cls_id", "sep_id", "mask_id"), "9")
    writer = TS.ShardWriter({"path": str(folder), **ids, **options}, overwrite)
    _, root = TS.filesystem(str(folder))
    LOCAL.create_dir(MF.located(root, writer.prefix, writer.staging), recursive=True)
    done = []
    for name in names:
        unique, out = writer._open(LOCAL, root, name, 4)
        out.write(bytes([token, 0] * 4))
        out.close()
        done.append((name, unique, out.size, out.crc32))
    return writer, [TS.WrittenShards(done)]


def seen(folder):
    """Name and tokens of what a reader finds."""
    try:
        shards = TS.list_shards(str(folder))
    except FileNotFoundError:
        return {}
    return {s.name: open(s.path, "rb").read()[1024] for s in shards}


def name(i):
    return f"fineweb_train_{i:06d}.bin"


@pytest.mark.parametrize("overwrite", [False, True])
@pytest.mark.parametrize("flat", ["true", "false"])
@pytest.mark.parametrize("first", ["none", "listed", "committed"])
def test_a_commit_that_dies_shows_a_whole_generation(tmp_path, monkeypatch, overwrite, flat, first):
    """Killed after every number of changes, a commit leaves the old shards or the new ones, and the next one works."""
    old, new = {name(i): 1 for i in range(3)}, {name(i): 2 for i in range(1, 5)}
    wanted = new if overwrite else old | new
    if first == "none":
        old, wanted = {}, new
    outcomes = set()
    for changes in range(40):
        folder = tmp_path / f"{changes}" / "s"
        folder.mkdir(parents=True)
        if first == "committed":
            writer, messages = staged(folder, old, 1, flat=flat)
            writer.commit(messages)
        elif first == "listed":
            for n in old:
                (folder / n).write_bytes(bytes(1024) + bytes([1, 0] * 4))
        writer, messages = staged(folder, new, 2, overwrite, flat=flat)
        with monkeypatch.context() as patch:
            dying = Dying(changes)
            patch.setattr(TS, "filesystem", lambda path: (dying, path))
            # One move after another, so that every order of steps is one of these runs.
            patch.setattr(TS, "COMMIT_THREADS", 1)
            try:
                writer.commit(messages)
                done = True
            except RuntimeError:
                done = False
        found = seen(folder)
        assert found in (old, wanted), changes
        outcomes.add(found == wanted)
        writer, messages = staged(folder, new, 3, overwrite, flat=flat)
        writer.commit(messages)
        assert seen(folder) == {n: 3 if n in new else t for n, t in (new if overwrite else old | new).items() for t in [old.get(n)]}
        if done:
            break
    assert done and outcomes == ({False, True})


def test_files_of_old_generations_go(tmp_path):
    folder = tmp_path / "s"
    for token in range(1, 6):
        writer, messages = staged(folder, [name(0), name(1)], token, overwrite=True)
        writer.commit(messages)
        assert seen(folder) == {name(0): token, name(1): token}
    kept = [p for p in tmp_path.rglob("*.bin*")]
    assert len(kept) == 2 * MF.KEPT
    assert MF.generations(LOCAL, str(folder), "fineweb") == [4, 5]


def test_two_writers(tmp_path, monkeypatch):
    """The second commit takes over what the first added in between."""
    folder = tmp_path / "s"
    first, second = staged(folder, [name(0)], 1), staged(folder, [name(1)], 2)
    real, raced = TS.put_manifest, []

    def late(fs, root, prefix, made):
        if made.generation == 1 and not raced:
            raced.append(True)
            second[0].commit(second[1])
        return real(fs, root, prefix, made)

    monkeypatch.setattr(TS, "put_manifest", late)
    first[0].commit(first[1])
    assert seen(folder) == {name(0): 1, name(1): 2}


def test_a_generation_is_put_once(tmp_path):
    root = str(tmp_path / "s")
    MF.put_manifest(LOCAL, root, "x", MF.Manifest(1))
    with pytest.raises(MF.GenerationTaken):
        MF.put_manifest(LOCAL, root, "x", MF.Manifest(1, {"a": MF.Entry("a", "a", 1)}))
    assert MF.read_manifest(LOCAL, root, "x").shards == {}
    assert [p for p in os.listdir(MF.manifest_dir(root, "x")) if "draft" in p] == []


def test_damage_is_found(spark, doc_tokens, tmp_path, identity):
    folder = tmp_path / "s"
    TS.write_shards(S.shard_pieces(S.stream_offsets(doc_tokens([300])), 64, 300), str(folder), identity)
    assert TS.damaged_shards(spark, str(folder)).count() == 0
    raw = (folder / name(1)).read_bytes()
    (folder / name(1)).write_bytes(raw[:-2] + b"zz")
    (folder / name(2)).write_bytes(raw[:-4])
    (folder / name(3)).unlink()
    found = {r["name"]: r["problem"] for r in TS.damaged_shards(spark, str(folder)).collect()}
    assert set(found) == {name(1), name(2), name(3)}
    assert found[name(1)] == "checksum differs" and found[name(3)] == "missing"


def drained(spark, folder, tmp_path, **options):
    """All rows that the stream has written so far, after going on from its checkpoint."""
    stream = SS.stream_windows(spark, str(folder), "train", WindowConfig(16), **options)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.schema(TS.SCHEMAS["windows"]).parquet(str(tmp_path / "out")).collect()
    return sorted((r["seq_idx"], r["input_ids"]) for r in rows)


@pytest.mark.parametrize("include_tail", [False, True])
def test_stream_yields_each_window_once(spark, doc_tokens, tmp_path, identity, include_tail):
    """Shards arrive in three steps and the stream is restarted after each; windows cross shards."""
    folder = tmp_path / "s"
    pieces = S.shard_pieces(S.stream_offsets(doc_tokens([30, 400, 7, 250])), 100, 687)
    folder.mkdir()
    assert drained(spark, folder, tmp_path, include_tail=include_tail) == []
    for low, high in ((0, 1), (2, 4), (5, 6)):
        TS.write_shards(pieces.where(F.col("shard_index").between(low, high)), str(folder), identity)
        found = drained(spark, folder, tmp_path, include_tail=include_tail)
        whole = sorted((r["seq_idx"], r["input_ids"]) for r in TS.read_windows(spark, str(folder), "train", WindowConfig(16)).collect())
        last = min((high + 1) * 100, 687) if include_tail else high * 100
        assert found == whole[: last // 16]
    stream = SS.ShardStreamReader({"path": str(folder), "split": "train", "seqLength": "16"})
    with pytest.raises(ValueError, match="were replaced"):
        stream.partitions({"windows": 3, "shards": 2, "digest": "other"}, json.loads(json.dumps(stream.latestOffset())))

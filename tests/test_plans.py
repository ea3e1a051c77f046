"""Documents to shards to batches, and the same from a stream."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.config import LoaderConfig, SpanConfig, WindowConfig, electra_config, mlm_config
from corpusloom.operators import stream as S
from corpusloom.operators import vocab as V
from corpusloom.operators.tokenize import tokenize
from corpusloom.plans import loading, pretokenize
from corpusloom.sources import documents as D
from corpusloom.sources import token_shards as TS
from corpusloom.streaming.packing import CommitLog, IncrementalPacker

SHARD = 20_000


@pytest.fixture(scope="module")
def documents(spark):
    return D.scan_documents(spark, f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def vocab(documents):
    return session.materialize(V.build_vocab(documents), "vocab")


@pytest.fixture(scope="module")
def corpus(spark, documents, vocab, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shards"))
    identity = V.identity_of(vocab)
    made = pretokenize.pretokenize(spark, documents, folder, lambda d: tokenize(d, vocab), identity, SHARD, 1)
    return made, folder, identity


def tokens_in(spark, folder):
    rows = TS.read_tokens(spark, folder).orderBy("shard_index", "start").collect()
    return [t for r in rows for t in r["tokens"]]


def test_pretokenize(spark, corpus):
    made, folder, _ = corpus
    stream = [t for r in made.doc_tokens.orderBy("doc_id").collect() for t in r["tokens"]]
    assert tokens_in(spark, folder) == stream
    assert len(TS.list_shards(folder)) == made.num_shards(SHARD)
    assert [s.split for s in TS.list_shards(folder)].count("val") == 1


def test_shards_of_another_size(spark, corpus, tmp_path):
    made, _, identity = corpus
    folder = str(tmp_path / "one")
    pretokenize.write_corpus(made, folder, identity, 50 * SHARD)
    stream = [t for r in made.doc_tokens.orderBy("doc_id").collect() for t in r["tokens"]]
    assert tokens_in(spark, folder) == stream


def test_a_folder_holds_one_corpus(spark, corpus, tmp_path):
    """Writing again is refused, or replaces all that was there."""
    made, _, identity = corpus
    folder = str(tmp_path / "again")
    pretokenize.write_corpus(made, folder, identity, SHARD)
    with pytest.raises(FileExistsError, match="already"):
        pretokenize.write_corpus(made, folder, identity, 2 * SHARD, val_shards=1)
    pretokenize.write_corpus(made, folder, identity, 2 * SHARD, val_shards=1, mode="overwrite")
    assert len(TS.list_shards(folder)) == made.num_shards(2 * SHARD)
    stream = [t for r in made.doc_tokens.orderBy("doc_id").collect() for t in r["tokens"]]
    assert tokens_in(spark, folder) == stream


def test_max_docs(spark, vocab, tmp_path):
    made = pretokenize.pretokenize(
        spark, f"{SMALL}/documents.parquet", str(tmp_path), lambda d: tokenize(d, vocab), V.identity_of(vocab),
        SHARD, max_docs=7,
    )
    assert sorted(r["doc_id"] for r in made.doc_tokens.collect()) == list(range(7))
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    again = pretokenize.pretokenize(
        spark, documents, str(tmp_path / "again"), lambda d: tokenize(d, vocab), V.identity_of(vocab), SHARD, max_docs=7
    )
    assert again.total_tokens == made.total_tokens


def test_corpus_paths():
    assert D.corpus_paths("10B", "/data/") == ("/data/sample-10BT", "data/fineweb_edu_10bt")
    assert D.corpus_paths("350B", "/d", "/out")[1] == "/out"
    with pytest.raises(ValueError, match="no corpus of size"):
        D.corpus_paths("1B", "/d")


def test_only_needed_columns_are_read(spark, documents):
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["mlm", "electra", "span_corruption"])
def test_training_batches(spark, corpus, name, tmp_path):
    made, folder, identity = corpus
    config = {
        "mlm": mlm_config(identity, seed=3),
        "electra": electra_config(identity, seed=3),
        "span_corruption": SpanConfig(identity, sentinel_start_id=60000, seed=3),
    }[name]
    loader = LoaderConfig(8, world_size=2)
    found = loading.training_batches(spark, folder, "train", name, config, WindowConfig(100), loader, seed=3, epoch=1)
    loading.write_batches(found, str(tmp_path / "b"), compact=name == "electra")
    rows = spark.read.parquet(str(tmp_path / "b")).collect()
    total = sum(s.token_count for s in TS.list_shards(folder, "train"))
    per_rank = total // 100 // 2 // 8
    assert len(rows) == 2 * 8 * per_rank
    assert {(r["rank"], r["batch_id"], r["pos_in_batch"]) for r in rows} == {
        (r, b, i) for r in range(2) for b in range(per_rank) for i in range(8)
    }
    assert len({r["seq_idx"] for r in rows}) == len(rows)
    if name != "span_corruption":
        assert all(len(r["input_ids"]) == 104 for r in rows)


def test_unshuffled_batches_move_nothing(spark, corpus):
    _, folder, identity = corpus
    loader = LoaderConfig(8, drop_last=False, shuffle=False)
    found = loading.training_batches(spark, folder, "val", "mlm", mlm_config(identity), WindowConfig(100), loader)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = found.collect()
    assert all((r["batch_id"], r["pos_in_batch"]) == divmod(r["seq_idx"], 8) for r in rows)
    assert len(rows) == SHARD // 100


def test_tokens_move_once(spark, corpus):
    _, folder, identity = corpus
    found = loading.training_batches(spark, folder, "train", "mlm", mlm_config(identity), WindowConfig(100))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan token_shards") == 1
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("Exchange hashpartitioning(bucket" in line for line in exchanges) <= 2


def test_resumed_batches_equal_the_straight_run(spark, corpus):
    made, folder, identity = corpus
    args = (spark, folder, "train", "mlm", mlm_config(identity), WindowConfig(100), LoaderConfig(8))
    straight = loading.training_batches(*args, seed=3)
    resumed = loading.training_batches(*args, seed=3, index=24)
    later = {(r["batch_id"] - 3, r["pos_in_batch"]): r["labels"] for r in straight.where("batch_id >= 3").collect()}
    assert {(r["batch_id"], r["pos_in_batch"]): r["labels"] for r in resumed.collect()} == later


def arriving(spark, documents, folder, parts):
    for low, high in parts:
        part = documents.where(F.col("doc_id").between(low, high))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_gives_the_same_shards(spark, documents, vocab, corpus, tmp_path):
    made, folder, identity = corpus
    packer = IncrementalPacker(str(tmp_path / "out"), lambda d: tokenize(d, vocab), identity, SHARD, 1)
    stream = arriving(spark, documents, str(tmp_path / "in"), [(0, 59), (60, 61), (62, 150)])
    packer.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    full = [s.name for s in TS.list_shards(packer.shard_dir)]
    assert all(s.token_count == SHARD for s in TS.list_shards(packer.shard_dir))
    arriving(spark, documents, str(tmp_path / "in"), [(151, 10**6)])
    packer.start(stream, str(tmp_path / "ckpt")).awaitTermination()
    packer.flush(spark)
    names = [s.name for s in TS.list_shards(packer.shard_dir)]
    assert set(full) < set(names) and names == [s.name for s in TS.list_shards(folder)]
    assert tokens_in(spark, packer.shard_dir) == tokens_in(spark, folder)


def test_repeated_and_broken_micro_batches(spark, documents, vocab, corpus, tmp_path, monkeypatch):
    """A batch that fails before its commit, or comes twice, leaves the result as it should be."""
    made, folder, identity = corpus
    packer = IncrementalPacker(str(tmp_path / "out"), lambda d: tokenize(d, vocab), identity, SHARD, 1)
    parts = [documents.where(F.col("doc_id").between(a, b)) for a, b in ((0, 80), (81, 120), (121, 10**6))]
    packer.process(parts[0], 0)
    with monkeypatch.context() as m:
        m.setattr(IncrementalPacker, "_write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            packer.process(parts[1].unionByName(parts[2]), 1)
    packer.process(parts[1], 1)
    packer.process(parts[1], 1)
    packer.process(parts[0], 0)
    packer.process(parts[2], 2)
    packer.process(documents.where("doc_id < 0"), 3)
    packer.flush(spark)
    packer.flush(spark)
    assert tokens_in(spark, packer.shard_dir) == tokens_in(spark, folder)


def test_full_shards_leave_no_tail(spark, identity, tmp_path):
    """A stream whose length is a multiple of the shard size; one document over three shards."""
    def tokens(d):
        return d.select("doc_id", F.expr("transform(sequence(1, 30), x -> x + 99)").alias("tokens"), F.lit(30).alias("n"))

    packer = IncrementalPacker(str(tmp_path / "out"), tokens, identity, 10)
    packer.process(spark.createDataFrame([(1, ""), (2, "")], "doc_id bigint, text string"), 0)
    packer.flush(spark)
    assert [s.token_count for s in TS.list_shards(packer.shard_dir)] == [10] * 6
    assert tokens_in(spark, packer.shard_dir) == list(range(100, 130)) * 2


def test_shared_folder(spark, monkeypatch):
    """The session's setting is used as it is."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.new_path(spark, "x").startswith(f"{configured}/corpusloom/")
    assert session.new_path(spark, "x") != session.new_path(spark, "x")


def test_commits_of_a_stream_are_few(spark, documents, vocab, corpus, tmp_path, monkeypatch):
    """Many batches leave the newest commits only, and one that is repeated goes on from the commit before it."""
    made, _, identity = corpus
    packer = IncrementalPacker(str(tmp_path / "out"), lambda d: tokenize(d, vocab), identity, SHARD, 1)
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (high - low) // 6 + 1
    parts = [documents.where(F.col("doc_id").between(low + i * step, low + (i + 1) * step - 1)) for i in range(6)]

    def lost(*_):
        raise RuntimeError("the driver is gone")

    for i, part in enumerate(parts):
        if i == 3:
            with monkeypatch.context() as patch:
                patch.setattr(CommitLog, "put", lost)
                with pytest.raises(RuntimeError, match="gone"):
                    packer.process(part, i)
        packer.process(part, i)
    packer.flush(spark)
    assert sorted(p.name for p in (tmp_path / "out" / "commits").iterdir()) == [f"batch_{i}.json" for i in (3, 4, 5)]
    assert sum(s.token_count for s in TS.list_shards(packer.shard_dir)) == made.total_tokens
    found, expected = (
        {(r["name"], r["start"]): r["tokens"] for r in TS.read_tokens(spark, f).select("name", "start", "tokens").collect()}
        for f in (packer.shard_dir, corpus[1])
    )
    assert found == expected

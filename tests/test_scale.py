"""What keeps queries in their limits on larger tables, with the results unchanged."""

import math
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.config import TokenIdentity
from corpusloom.functions import draws as D
from corpusloom.operators import pooling as P
from corpusloom.operators import subwords as SW
from corpusloom.operators import tokenize as T
from corpusloom.operators import vocab as V
from corpusloom.plans import queries as Q
from corpusloom.sources import token_shards as TS
from corpusloom.streaming.packing import IncrementalPacker

# The JVM doesn't compile longer methods.
LONGEST_METHOD = 8000


def test_vectors_are_mixed_in_order_by_short_methods(spark):
    rows = [(i, 0, i, [0.1 * i + 0.37 * k for k in range(Q.VECTOR_DIMS)]) for i in range(50)]
    odd = [[1.0] * 3, None, [1.0] * Q.VECTOR_DIMS + [9.0], [], [1.0, None, *[2.0] * (Q.VECTOR_DIMS - 2)], [1.0] * Q.VECTOR_DIMS + [None]]
    rows += [(100 + i, 0, i, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "seq_idx bigint, pos int, token_id int, vec array<float>")
    found = Q._vectors(table)
    plain = " + ".join(["0D", *(f"{i + 1} * CAST(get(vec, {i}) AS DOUBLE)" for i in range(Q.VECTOR_DIMS))])
    wanted = table.select("seq_idx", F.expr(f"round({plain}, 6)").alias("vec_mix"))
    assert {r["seq_idx"]: r["vec_mix"] for r in found.collect()} == {r["seq_idx"]: r["vec_mix"] for r in wanted.collect()}
    code = spark._jvm.PythonSQLUtils.explainString(Q._vectors(table)._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < LONGEST_METHOD


def _peak(run) -> int:
    """Bytes that Python objects take at most while ``run`` runs."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tokens_of_a_batch_are_no_python_lists():
    texts = pa.array(["a b c d e f g h " * 50] * 2000)
    vocab = SimpleNamespace(value={w: 300 + i for i, w in enumerate("abcdefgh")})
    found = []
    peak = _peak(lambda: found.append(T._encoder(vocab, 2, 3).func(texts)))
    assert [len(x) for x in found[0][:3]] == [401] * 3 and found[0][7].as_py()[-2:] == [307, 2]
    assert peak < 7 * 2000 * 401


def test_word_counts_are_handed_on(monkeypatch):
    monkeypatch.setattr(V, "COUNTED_AT_ONCE", 100)
    texts = [" ".join(f"w{k}" for k in range(30 * i, 30 * i + 60)) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20])], ["text"]) for i in (0, 20)]
    made = list(V._word_counter()(iter(batches)))
    assert max(x.num_rows for x in made) <= 160
    counts = Counter()
    for batch in made:
        counts.update(dict(zip(*(c.to_pylist() for c in batch.columns))))
    assert counts == Counter(w for text in texts for w in text.split())


@pytest.mark.parametrize("probability", [0.0, 0.3, 1 / 3, 1.0])
def test_choices_by_md5_convert_no_digits(spark, probability):
    keys = ("md5", D.MASK, 7, 3, F.col("id"), F.col("id") % 5)
    table = spark.range(3000).withColumn("own", D.chosen(probability, *keys))
    draws = table.withColumn("drawn", D.draw(*keys) < F.lit(math.floor(probability * D.DRAW_RANGE)).cast("bigint"))
    assert draws.where("own != drawn OR own IS NULL").count() == 0
    plan = spark.range(1).select(D.chosen(0.3, *keys))._jdf.queryExecution().analyzed().toString()
    assert "conv(" not in plan


def test_pieces_of_a_stream_have_no_folder_per_shard(spark, tmp_path):
    rows = [(i, [i % 50 + 300] * 9 + [2], 10) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>, n int")
    packer = IncrementalPacker(str(tmp_path), lambda d: d, TokenIdentity(vocab_size=400), shard_size=70)
    for k in range(2):
        packer.process(docs.where(F.col("doc_id").between(100 * k, 100 * k + 99)), k)
    packer.flush(spark)
    assert not [*(tmp_path / "pieces").rglob("shard_index=*")]
    read = TS.read_tokens(spark, packer.shard_dir).orderBy("shard_index", "start").collect()
    assert [x for r in read for x in r["tokens"]] == [x for _, tokens, _ in rows for x in tokens]


def test_merges_look_up_only_pairs_beside_a_merge():
    looked = []

    class Counted(dict):
        def get(self, pair, other=None):
            looked.append(pair)
            return super().get(pair, other)

        def __contains__(self, pair):
            looked.append(pair)
            return super().__contains__(pair)

    pairs = [(97, 97, 256), (256, 256, 257), (98, 97, 258), (257, 98, 259)]
    ranks = Counted({(a, b): (rank, token) for rank, (a, b, token) in enumerate(pairs)})
    merges = SW.Merges(tuple(range(256)), ranks)
    merges.__dict__["_codes"] = Counted({pair: rank << 16 | token for pair, (rank, token) in ranks.items()})
    for piece in (b"aaaa" * 8, b"baaab" * 9, b"aabab", b"a", b""):
        looked.clear()
        assert merges.encode(piece) == merges._by_heap(list(piece))
    looked.clear()
    merges.encode(b"aaaa" * 16)
    assert len(looked) < 4 * 64


def test_vectors_are_joined_once_per_token_and_block(spark, monkeypatch):
    monkeypatch.setattr(P, "SEQUENCES_PER_BLOCK", 8)
    rows = [(k if k else None, [0, 1 + k % 2, 3, 3] * 50 if k % 7 else []) for k in range(64)] + [(5, [4] * 10)]
    samples = spark.createDataFrame(rows, "seq_idx bigint, input_ids array<int>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1)]) for i in range(5)], "token_id int, vec array<float>")
    joined = []
    monkeypatch.setattr(P, "_all_known", lambda df, real=P._all_known: joined.append(df) or real(df))
    found = P.embed_sequences(samples, vectors, 0, max_broadcast_bytes=0).collect()
    # Sixteen thousand positions, nine blocks of four tokens.
    assert joined[0].count() <= 9 * 4 + 8
    of = {}
    for k, ids in rows:
        of.setdefault(k, []).extend(i for i in ids if i)
    for r in found:
        ids = of[r["seq_idx"]] if r["seq_idx"] is not None else []
        want = [sum(ids) / len(ids), sum(1.0 / (i + 1) for i in ids) / len(ids)] if ids else [0.0, 0.0]
        assert r["pooled"] == pytest.approx(want, abs=1e-6)
    assert len(found) == len(rows)
    with pytest.raises(Exception, match="No vector for token 9"):
        strange = spark.createDataFrame([(1, [9])], "seq_idx bigint, input_ids array<int>")
        P.embed_sequences(strange, vectors, 0, max_broadcast_bytes=0).collect()

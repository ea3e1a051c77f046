import brute
import corpus_pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from corpusloom.session import materialize


def after(docs, items):
    """Documents (id, text, source) that the first three stages keep."""
    docs = [d for d in docs if brute.kept(d[1])]
    classes = brute.near_components([brute.fingerprint(t) for _, t, _ in docs])
    least = brute.smallest_ids([d[0] for d in docs], classes)
    docs = [d for d, c in zip(docs, least) if d[0] == c]
    hit = {r[0] for r in brute.contaminated([d[:2] for d in docs], items) if r[-1]}
    return [d for d in docs if d[0] not in hit]


def test_run(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = after(texts, items)
    docs = spark.createDataFrame(kept, "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    wanted = sorted(x for d in brute.sizes([k[:2] for k in kept]) for x in [d] * copies[d[0]])
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == wanted
    assert len({(r["shard"], r["slot"]) for r in found}) == len(found)


def test_stages_keep_columns(spark, odd, clashing):
    docs = clashing(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SMALL)
        assert made.columns == docs.columns, name
        docs = materialize(made, "stage")


def test_stages_on_empty_tables(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), "stage")
    assert docs.count() == 0


def test_hidden_rows_in_each_stage(spark, odd):
    """Odd rows reach every stage, not only the first."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 0

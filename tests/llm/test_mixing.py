from collections import defaultdict

import brute
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.llm import mixing, queries


def words(text):
    return len(brute.SPACE_WORD.findall(text or ""))


def check(rows, docs):
    """``rows``: (doc_id, source, size, source_size, target, copies), one per row of ``docs`` (id, text, source)."""
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += words(t)
    wanted = brute.targets(dict(sizes))
    assert sorted(((d, s, n) for d, s, n, *_ in rows), key=str) == sorted(((d, s, words(t)) for d, t, s in docs), key=str)
    taken, largest = defaultdict(int), defaultdict(int)
    for _, s, n, source_size, target, copies in rows:
        assert source_size == sizes[s] and target == pytest.approx(wanted[s])
        due = target / source_size if source_size else 0
        assert copies in (int(due), int(due) + 1) and copies <= 2
        taken[s] += n * copies
        largest[s] = max(largest[s], n)
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= largest[s] + 1e-6


def unfolded(units):
    return [
        tuple(r)
        for r in units.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
        .collect()
    ]


def test_odd_rows(odd, odd_rows):
    check(unfolded(mixing.mix(odd)), [(r[0], r[1], r[3]) for r in odd_rows])


def test_repeated_rows(spark, clashing):
    """A thousand equal rows are dealt whole copies; none is taken three times, and the mix has what was decided."""
    rows = [(7, "w " * 10, "b")] * 1000 + [(i, "w " * (i % 9), "a") for i in range(100, 900)] + [(8, "w w", "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(unfolded(mixing.mix(docs)), rows)
    # Equal in id, source and text, but not in all columns.
    docs = clashing(docs.withColumn("other", F.pmod(F.monotonically_increasing_id(), F.lit(3))))
    made = mixing.mixed(docs)
    taken = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("rows") * F.col("copies")).alias("n")).collect()}
    assert {r["source"]: r["count"] for r in made.groupBy("source").count().collect()} == taken
    assert made.columns == docs.columns
    most = made.join(docs.groupBy(*docs.columns).agg(F.count("*").alias("given")), docs.columns).groupBy(*docs.columns)
    assert most.agg((F.count("*") / F.first("given")).alias("x")).agg(F.max("x")).first()[0] <= 2


def test_hot_source_and_levels(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(unfolded(mixing.mix(docs)), rows)
    # Small blocks take several levels.
    units = [tuple(r) for r in docs.select("doc_id", "source").collect()]
    assert len(units) == 600
    fractions = docs.select(
        F.struct("doc_id", "source", F.lit(0).cast("long").alias("th")).alias("unit"),
        F.lit(3).cast("long").alias("mass"),
        F.lit(0.25).alias("p"),
        F.count("*").over(mixing.Window.partitionBy("source")).alias("n"),
    )
    found = mixing.round_pivotal(fractions, 600, block=4).collect()
    assert len(found) == 600 and len({r["unit"]["doc_id"] for r in found}) == 600
    by_source = defaultdict(list)
    for r in found:
        by_source[r["unit"]["source"]].append(r["up"])
    assert all(abs(sum(x) - 0.25 * len(x)) < 1 for x in by_source.values())


def test_expectation_stays(spark):
    """Over many sources alike, each with draws of its own, a document is taken as often as it is due."""
    runs, ups = 400, defaultdict(int)
    rows = [(i, f"s{s}", (i % 4 + 1) * 10, 0.1 + 0.2 * (i % 4)) for i in range(12) for s in range(runs)]
    base = spark.createDataFrame(rows, "doc_id bigint, source string, mass bigint, p double")
    unit = F.struct("doc_id", "source", F.lit(0).cast("long").alias("th")).alias("unit")
    rounded = mixing.round_pivotal(base.select(unit, "mass", "p", F.lit(12).alias("n")), 12, block=8)
    for r in rounded.where("up").collect():
        ups[r["unit"]["doc_id"]] += 1
    for i, _, _, p in rows[::runs]:
        assert abs(ups[i] / runs - p) < 0.1


def test_reruns_agree(odd):
    first = sorted(map(str, mixing.mix(odd).collect()))
    assert sorted(map(str, mixing.mix(odd.repartition(7)).collect())) == first


def test_mixed_rows(odd, clashing):
    docs = clashing(odd)
    copies = defaultdict(int)
    for r in mixing.mix(odd).collect():
        copies[r["doc_id"], r["source"], r["th"]] += r["rows"] * r["copies"]
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    found = defaultdict(int)
    for r in made.withColumn("h", mixing.text_hash(F.col("text"))).collect():
        found[r["doc_id"], r["source"], r["h"]] += 1
    assert found == {k: v for k, v in copies.items() if v}


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_query(spark, texts):
    source = {i: s for i, _, s in texts}
    rows = queries.op4_mixing(spark, SMALL).collect()
    made = [(r["doc_id"], source[r["doc_id"]], r["size"], r["source_size"], r["target"], r["taken"] // r["size"]) for r in rows]
    check(made, texts)

import hashlib
import zlib

import pytest
from compare import database, difference
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.llm import merkle as M
from corpusloom.llm import queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fanout):
    """Top, and each leaf's (left, right) siblings level by level."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a - a % fanout
            proofs[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + fanout])))
        nodes = [digest(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], proofs


def expected(rows, fanout):
    """Rows (doc_id, leaf, subroot, root, steps) from rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(groups[x])], fanout) for x in langs}
    if not langs:
        return []
    root, over = tree([trees[x][0] for x in langs], fanout)
    made = []
    for lang, above in zip(langs, over):
        top, proofs = trees[lang]
        for (known, key, made_leaf), steps in zip(sorted(groups[lang]), proofs):
            made.append((key if known else None, made_leaf, top, root, steps + above))
    return sorted(made, key=str)


def actual(docs, fanout):
    found = M.manifest(docs, M.leaf_digest(*[F.col(f) for f in FIELDS]), F.col("lang"), F.col("doc_id"), F.struct("doc_id"), fanout)
    rows = found.withColumn("folded", M.fold(F.col("digest"), F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in rows)
    made = [(r["info"]["doc_id"], r["digest"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in rows]
    return sorted(made, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


@pytest.mark.parametrize("fanout", [2, 3, 5, 20])
def test_odd_rows(spark, odd_rows, clashing, fanout):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    assert actual(clashing(table(spark, rows)), fanout) == expected(rows, fanout)


@pytest.mark.parametrize("sizes", [[1], [2], [7], [8], [9], [17, 1], [1, 1, 1, 1, 1], [64, 65, 3]])
def test_sizes(spark, sizes):
    """Trees of few, of exactly full and of barely more levels, next to each other."""
    rows = [(i, "s", f"lang{g}", i, f"text {i}") for g, n in enumerate(sizes) for i in range(g * 100, g * 100 + n)]
    assert actual(table(spark, rows), 2) == expected(rows, 2)


def test_ranges_within_a_group(spark, monkeypatch):
    """A group that holds most rows spans many ranges; places count on over them."""
    monkeypatch.setattr(M, "ROWS_PER_TASK", 40)
    rows = [(i * 37 % 1009, "s", "big" if i % 10 else f"l{i % 70}", i, "t") for i in range(900)]
    assert actual(table(spark, rows), 2) == expected(rows, 2)


def test_changed_value_is_found(spark):
    rows = [(i, "s", f"l{i % 3}", i, "t") for i in range(40)]
    docs = table(spark, rows)
    other = M.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    found = M.manifest(docs, M.leaf_digest(*[F.col(f) for f in FIELDS]), F.col("lang"), F.col("doc_id"), F.struct(other.alias("other")))
    assert found.where(M.fold(F.col("info.other"), F.col("steps")) == F.col("root")).count() == 0


def test_null_is_no_text(spark):
    one = spark.range(1).select(M.leaf_digest(F.lit(None).cast("string")), M.leaf_digest(F.lit("-")), M.leaf_digest(F.lit("")))
    assert len(set(one.first())) == 3


def test_bad_fanout(spark):
    with pytest.raises(ValueError, match="slots"):
        actual(table(spark, [(1, "s", "l", 1, "t")]), 1)


def test_empty(spark):
    assert actual(table(spark, []), 2) == []


def test_query_and_statement(spark, texts):
    found = queries.op11_merkle(spark, SMALL).toPandas()
    assert difference(found, database(SMALL).execute(queries.oracle_sql()["op11_merkle"]).df()) is None
    tampered = {d for d, _, _ in texts if zlib.crc32(str(d).encode()) % 7 == 0}
    assert set(found.loc[~found["verified"], "doc_id"]) == tampered

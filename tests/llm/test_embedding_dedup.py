import numpy as np
import pytest
from compare import database, difference
from conftest import SMALL

from corpusloom.llm import embedding_dedup as E
from corpusloom.llm import queries

SCHEMA = "vec_id bigint, embedding array<float>"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def expected(rows, threshold=0.9):
    """(id, links, smallest id reached) by comparing all pairs."""
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = [0] * n
    vectors = [np.array(v, np.float64) if usable(v) else None for _, v in rows]
    for i in range(n):
        for j in range(i + 1, n):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                degree[i] += 1
                degree[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        ids = [x for x in (least.get(find(i)), rows[i][0]) if x is not None]
        least[find(i)] = min(ids, default=None)
    return sorted([(rows[i][0], degree[i], least[find(i)]) for i in range(n)], key=str)


def actual(df):
    return sorted((tuple(r) for r in df.select("id", "n_links", "component_id").collect()), key=str)


def drawn(seed, n, dim, centres):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * rng.uniform(0.1, 1.2, (n, 1))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_all_pairs(spark, threshold, monkeypatch):
    """Links within and between bands and tiles; tiles of few vectors."""
    monkeypatch.setattr(E, "TILE_BYTES", 1 << 20)
    monkeypatch.setattr(E, "BAND_BYTES", 1 << 15)
    rows = drawn(3, 600, 24, 12)
    found = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold=threshold)
    assert actual(found) == expected(rows, threshold)


def test_odd_rows(spark, clashing):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [2.0, 0.0]), (10, [-1.0, 0.0]), (None, [1.0, 0.01]),
        (11, [1e-30, 1e-30]), (12, [1e30, 1e30]), (13, [1.0, 0.0, 0.0]), (14, [1.0]), (15, [3.0]), (None, [0.0, -1.0]),
        (7, [0.0, 1.0]), (16, [float(x) for x in range(1, 1500)]), (17, [float(x) for x in range(2, 1501)]),
    ]
    found = E.near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA)))
    assert actual(found) == expected(rows)


def test_copies_and_a_cluster(spark):
    """A third of all rows is one vector, another third lies within the threshold of one another."""
    base = drawn(4, 200, 16, 200)
    rng = np.random.default_rng(5)
    near = (np.ones(16) + rng.normal(size=(200, 16)) * 0.05).astype(np.float32)
    rows = base + [(1000 + i, base[7][1]) for i in range(200)] + [(2000 + i, v.tolist()) for i, v in enumerate(near)]
    found = E.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert actual(found) == expected(rows)


def test_bounds_hold():
    """No pair's product passes what its boxes or suffixes allow."""
    x = E._unit([np.array(v) for _, v in drawn(6, 300, 32, 5)], 32)
    values, turn = np.linalg.eigh(x.T @ x)
    axes = E.Axes(turn[:, ::-1].copy(), np.sqrt(np.maximum(values[::-1], 0) / values.sum()), (8, 16))
    turned = axes.turned(x)
    assert np.allclose(turned @ turned.T, x @ x.T)
    tails = E._tail(turned, 8)
    assert (turned[:, :8] @ turned[:, :8].T + np.outer(tails, tails) >= x @ x.T - 1e-12).all()
    box = {"low": turned[:150, :8].min(axis=0), "high": turned[:150, :8].max(axis=0), "tail": tails[:150].max()}
    other = {"low": turned[150:, :8].min(axis=0), "high": turned[150:, :8].max(axis=0), "tail": tails[150:].max()}
    assert E._reach(box, other) >= (x[:150] @ x[150:].T).max() - 1e-12


def test_bad_threshold(spark):
    with pytest.raises(ValueError, match="threshold"):
        E.near_duplicates(spark.createDataFrame([], SCHEMA), threshold=0.0)


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert actual(E.near_duplicates(spark.createDataFrame([(1, None)], SCHEMA))) == [(1, 0, 1)]


def test_query_and_statement(spark):
    found = queries.op13_embeddings(spark, SMALL).toPandas()
    assert difference(found, database(SMALL).execute(queries.oracle_sql()["op13_embeddings"]).df()) is None

import random
import zlib

import numpy as np
import pytest
from brute import SPACE_WORD, sha
from conftest import SMALL

from corpusloom.llm import periodic as P
from corpusloom.llm import queries


def all_runs(w):
    """(start, length, period) of every run of at least two periods, straight from the definition."""
    n, found = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= 2 * p and not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                found.add((i, length, p))
            i = j + 1
    return found


def strong(w):
    """Runs of at least 6 words and 4 periods; found by stretches of equal words, longest periods last."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            # A stretch with a smaller period that divides p was found with that one.
            if length >= max(6, 4 * p) and (i, length) not in found:
                found[i, length] = p
            i = j + 1
    return sorted((i, length, p) for (i, length), p in found.items())


def expected(rows):
    made = []
    for key, text in rows:
        words = SPACE_WORD.findall(text or "")
        n = len(words)
        h = 1 if key is None else zlib.crc32(str(key).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = strong(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        made.append((key, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)))
    return sorted(made, key=str)


def actual(df):
    columns = ("id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def drawn(rng):
    n, symbols = rng.randint(1, 45), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(symbols) for _ in range(n)]
    if rng.random() < 0.4:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_runs_are_all_runs():
    rng = random.Random(5)
    for _ in range(600):
        w = drawn(rng)
        start, length, period = P.runs_of(np.array(w))
        assert set(zip(start.tolist(), length.tolist(), period.tolist())) == all_runs(w), w


def test_cutting_loses_no_run():
    """Runs inside texts of other words, next to each other and overlapping."""
    rng = random.Random(6)
    for _ in range(300):
        w = [x + 1000 * rng.randrange(2) * rng.randrange(50) for _ in range(4) for x in drawn(rng)]
        found = P.word_runs(np.array(w))
        assert found == sorted(r for r in all_runs(w) if r[1] >= max(6, 4 * r[2])), w


@pytest.mark.parametrize("w", [[0] * 50, [0, 1] * 30, [0, 0, 1] * 20 + [0], list(range(30)), [3], [0, 1, 0, 0, 1, 0, 1, 0] * 6])
def test_extensions(w):
    tree = P.SuffixTree(w)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(w)), np.arange(len(w))))
    a, b = a[a != b], b[a != b]
    common = [next((k for k in range(len(w)) if max(x, y) + k >= len(w) or w[x + k] != w[y + k]), 0) for x, y in zip(a, b)]
    if len(a):
        assert tree.extension(a, b).tolist() == common
    assert tree.rank.tolist() == [sorted(range(len(w) + 1), key=lambda i: w[i:]).index(i) for i in range(len(w) + 1)]


def test_long_period():
    w = [i % 4001 for i in range(18000)]
    assert P.word_runs(np.array([*range(5000, 6000), *w])) == [(1000, 18000, 4001)]


def test_odd_rows(spark, odd, odd_rows, clashing):
    rows = [*odd_rows, (300, "a b " * 9, "en", "s", 3), (301, "a " * 6, "en", "s", 3), (302, "a " * 5, "en", "s", 3), (303, "x y z " * 3000, "en", "s", 9)]
    # The brute version is quadratic, so the long text is shorter here.
    rows = [(r[0], " ".join(r[1].split()[:3000]) if r[0] == 4 else r[1], *r[2:]) for r in rows]
    docs = clashing(spark.createDataFrame(rows, odd.schema))
    assert actual(P.find_runs(docs, change=P.periodic_tail)) == expected([r[:2] for r in rows])


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so so so so so so said  she\n" * 5), (2, None)], "doc_id bigint, text string")
    found = {r["id"]: r["collapsed"] for r in P.find_runs(docs, with_text=True).collect()}
    assert found == {1: "so said she", 2: ""}


def test_empty(empty):
    assert P.find_runs(empty).count() == 0


def test_query(spark, texts):
    found = queries.op12_runs(spark, SMALL).withColumnRenamed("doc_id", "id")
    assert actual(found) == expected([t[:2] for t in texts])

import brute
import numpy as np
import pytest
from conftest import SMALL  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import decontamination as D
from corpusloom.llm import queries


def digest(df):
    return df.select(
        "id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def items(spark, texts):
    """Passages of documents, short items, a repeated one, nulls."""
    made = [(k, " ".join((t or "").split()[5 : 5 + n])) for k, (_, t, _) in enumerate(texts[:20]) for n in (3, 14, 30)]
    made += [(900, "the"), (901, ""), (902, None), (903, "..."), (0, "word"), (None, texts[30][1])]
    return made


def test_against_plain_search(spark, odd, odd_rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.find_matches(odd, bench)
    assert rows(digest(found)) == sorted(brute.contaminated([(r[0], r[1]) for r in odd_rows], items), key=str)


def test_blocks_and_shards_change_nothing(spark, odd, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = rows(digest(D.find_matches(odd, bench)))
    assert rows(digest(D.find_matches(odd, bench, block_words=60, shard_words=300))) == whole


def test_matches_are_maximal_and_in_place(spark):
    item = "a b c d e f g h i j k l m n o p q r s t"
    doc = "x " + item[:35] + " y y " + item + " z"
    docs = spark.createDataFrame([(1, doc)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    found = D.find_matches(docs, bench, matches=True).first()
    assert [tuple(m) for m in sorted(found["matches"], key=lambda m: m["doc_start"])] == [("7", 1, 0, 18), ("7", 21, 0, 20)]
    assert [tuple(s) for s in found["spans"]] == [(1, 18), (21, 20)]
    assert [tuple(m) for m in found["longest"]] == [("7", 21, 0, 20)]


def packed(items, window):
    group = D.Group(window)
    for name, text in items:
        group.add(name, D.split_words(text))
    return group.packed()


def test_shared_preamble_is_one_window():
    """2,000 items that share a preamble: it is looked up once, and its places aren't paired with the items."""
    preamble = "answer the following question with one of the four letters"
    group = packed([(str(k), preamble) for k in range(2000)], 10)
    assert len(group.bounds) == 2
    _, (found,) = D._find([f"{preamble} " * 500], [group], 1 << 20, False)
    assert len(found.items) == 2000 and len(found.longest) == 2000 and not found.matches
    assert found.spans == [{"doc_start": 0, "n": 5000}]


def test_long_item_is_found_in_few_steps(monkeypatch):
    """No comparison goes on word by word past a window."""
    text = " ".join(f"w{(k * k) % 7919}" for k in range(16000))
    group, limits, common = packed([("long", text)], 10), [], D.Index.common
    monkeypatch.setattr(D.Index, "common", lambda self, at, w, s, limit: (limits.append(limit.max()), common(self, at, w, s, limit))[1])
    _, (found,) = D._find([text], [group], 1 << 20, False)
    assert found.longest == [{"item": "long", "doc_start": 0, "item_start": 0, "n": 16000}] and max(limits) == 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=40), st.integers(1, 4))
def test_longest_matches(items, words, window):
    """Against a search of every stretch of every item."""
    group = packed([(str(k), " ".join(map(str, x))) for k, x in enumerate(items)], window) if any(len(x) >= window for x in items) else None
    if group is None:
        return
    _, (found,) = D._find([" ".join(map(str, words))], [group], 1 << 20, False)

    def occurs(part):
        return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))

    wanted = {}
    for k, x in enumerate(items):
        lengths = [n for n in range(window, len(x) + 1) for a in range(len(x) - n + 1) if occurs(x[a : a + n])]
        if lengths:
            wanted[str(k)] = max(lengths)
    assert {m["item"]: m["n"] for m in found.longest} == wanted and found.items == set(wanted)
    for m in found.longest:
        own = items[int(m["item"])][m["item_start"] : m["item_start"] + m["n"]]
        assert words[m["doc_start"] : m["doc_start"] + m["n"]] == own


def test_clean_rows_stay_as_they_are(spark, odd, items, clashing):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    marked = {r["id"]: r["n_hit"] for r in D.find_matches(odd, bench).collect()}
    docs = clashing(odd)
    left = D.remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert all(not marked[r["doc_id"]] or r["doc_id"] == 5 for r in left.collect())
    assert left.count() == sum(not n for n in (r["n_hit"] for r in D.find_matches(odd, bench).collect()))


def test_empty_tables(spark, odd, empty, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert D.find_matches(empty, bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_matches(odd, none).where("n_hit > 0").count() == 0
    assert D.remove_contaminated(odd, none).count() == odd.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_suffix_array(ids, depth):
    text = np.array(ids)
    order = D.suffix_array(text, depth)
    padded = [tuple((ids[i:] + [0] * depth)[:depth]) for i in order]
    assert sorted(order) == list(range(len(ids))) and padded == sorted(padded)


def test_query(spark, texts):
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = queries.op1_decontamination(spark, SMALL)
    assert rows(found) == sorted(brute.contaminated([(i, t) for i, t, _ in texts], bench), key=str)

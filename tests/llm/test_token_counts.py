import string

import brute
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries
from corpusloom.llm import token_counts as T

PIECES = set(T.read_pieces(T.VOCABULARY))


@pytest.fixture(scope="module")
def automaton():
    return T.Automaton(PIECES)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abcd", max_size=14))
def test_small_vocabularies(pieces, word):
    assert T.Automaton(pieces).pieces(word) == (brute.greedy_pieces(word, pieces))


@settings(max_examples=200, deadline=None)
@given(st.text(string.ascii_letters + "éñü,.1￿", max_size=30))
def test_public_vocabulary(automaton, word):
    assert automaton.pieces(T.MARK + word) == brute.greedy_pieces(T.MARK + word, PIECES)


def test_long_words_take_one_walk(automaton):
    assert automaton.pieces(T.MARK + "the" * 200_000) == brute.greedy_pieces(T.MARK + "the" * 200, PIECES) + (200_000 - 200) * (
        brute.greedy_pieces(T.MARK + "the" * 200, PIECES) - brute.greedy_pieces(T.MARK + "the" * 100, PIECES)
    ) // 100


def expected(docs):
    rows = []
    for d, t in docs:
        found = [brute.greedy_pieces(T.MARK + w, PIECES) for w in brute.SPACE_WORD.findall(t or "")]
        rows.append((d, len(found), sum(1 if n is None else n for n in found), sum(n is None for n in found)))
    return sorted(rows, key=str)


def test_odd_rows(odd, odd_rows, clashing):
    found = T.count_tokens(clashing(odd), memory=50).collect()
    assert sorted(map(tuple, found), key=str) == expected([(r[0], r[1]) for r in odd_rows])


def test_text_vocabulary(spark, tmp_path):
    path = tmp_path / "vocabulary.txt"
    path.write_text("un\n##aff\n##able\n##a\n")
    docs = spark.createDataFrame([(1, "unaffable una xyz"), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, T.count_tokens(docs, str(path)).collect())) == [(1, 3, 6, 1), (2, 0, 0, 0)]


def test_empty(empty):
    assert T.count_tokens(empty).count() == 0


def test_query(spark, texts):
    found = queries.op3_token_counts(spark, SMALL).collect()
    assert sorted(map(tuple, found), key=str) == expected([(i, t) for i, t, _ in texts])

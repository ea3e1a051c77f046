import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.arrays import guard_ids
from corpusloom.operators import tokenize as T
from corpusloom.operators import vocab as V

SENTENCES = [
    "The quick brown fox jumps over the lazy dog.",
    "Token streams are cut into windows of one length.",
    "A document may span two windows, or many.",
    "Separators mark where a document ends.",
    "Nothing is padded between documents!",
]


@pytest.fixture
def documents(spark):
    rows = list(enumerate([*SENTENCES, "", "  \n ", "word " * 10000, "café, naïve 日本", None]))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def brute_words(text):
    return re.findall(r"[A-Za-z0-9_]+|[^ \t\n\rA-Za-z0-9_]", text or "")


def brute_vocab(texts, size):
    counts = {}
    for text in texts:
        for word in brute_words(text):
            counts[word] = counts.get(word, 0) + 1
    ranked = sorted(counts.items(), key=lambda c: (-c[1], c[0].encode()))[: size - 5]
    return {word: 4 + i for i, (word, _) in enumerate(ranked)}


@pytest.mark.parametrize("size", [12, 30, 50265])
def test_vocab(documents, size):
    found = {r["token"]: r["token_id"] for r in V.build_vocab(documents, size).collect()}
    assert found == brute_vocab([r["text"] for r in documents.collect()], size)


def test_vocab_size_is_checked(documents):
    for size in (5, 65537):
        with pytest.raises(ValueError):
            V.build_vocab(documents, size)


@pytest.mark.parametrize("size", [12, 50265])
@pytest.mark.parametrize("way", [T.tokenize, T.tokenize_by_join])
def test_tokenize(documents, size, way):
    """Both ways of looking words up give the same ids, also for a word that is most of the text."""
    vocab = V.build_vocab(documents, size)
    ids = brute_vocab([r["text"] for r in documents.collect()], size)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for row in way(documents, vocab).collect():
        assert row["tokens"] == [ids.get(w, 3) for w in brute_words(texts[row["doc_id"]])] + [2]
        assert row["n"] == len(row["tokens"])


@pytest.mark.parametrize("way", [T.tokenize, T.tokenize_by_join])
def test_repeated_keys_stay_two_rows(spark, documents, way):
    vocab = V.build_vocab(documents)
    twice = documents.where("doc_id = 0").unionByName(documents.where("doc_id = 0"))
    rows = way(twice, vocab).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_empty_text_is_a_separator(documents):
    rows = T.tokenize(documents, V.build_vocab(documents)).where("doc_id IN (5, 6, 9)").collect()
    assert [r["tokens"] for r in rows] == [[2], [2], [2]]


def test_no_documents(spark, documents):
    none = documents.where("doc_id < 0")
    vocab = V.build_vocab(none)
    assert vocab.count() == 0 and V.identity_of(vocab).vocab_size == 5
    assert T.tokenize(none, vocab).count() == 0
    assert T.tokenize(documents, vocab).where("doc_id = 0").first()["tokens"] == [3] * 10 + [2]


def test_users_tokenizer(spark, documents, tmp_path):
    """A byte-level tokenizer gives the text back."""
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer(tokenizers.models.BPE())
    made.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.decoder = tokenizers.decoders.ByteLevel()
    trainer = tokenizers.trainers.BpeTrainer(
        vocab_size=400, special_tokens=["<s>", "<pad>", "</s>", "<unk>"],
        initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet(),
    )
    made.train_from_iterator(SENTENCES, trainer)
    path = str(tmp_path / "tokenizer.json")
    made.save(path)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = T.tokenize_with_file(documents, path).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["tokens"][-1] == 2 and 0 not in row["tokens"]
        assert made.decode(row["tokens"][:-1]) == (texts[row["doc_id"]] or "")
        assert row["n"] == len(row["tokens"])


def test_range_violations(spark):
    rows = [(1, [0, 65535]), (2, [-1, 5, 65536])]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")
    assert [tuple(r) for r in T.range_violations(df).collect()] == [(2, 2)]
    assert df.where("doc_id = 1").select(guard_ids(F.col("tokens"))).first()[0] == [0, 65535]
    with pytest.raises(Exception, match="uint16"):
        df.select(guard_ids(F.col("tokens"))).collect()

import random

import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from corpusloom.operators import subwords as SW
from corpusloom.plans.queries import SUBWORD_SEPARATOR, TOKENIZER_FILE
from corpusloom.sources.documents import scan_documents

ODD = [
    "", " ", "  two  spaces  ", "tab\tand\r\nlines\n\n\n end ", "it's we'll I'd THEY'RE", "naïve façade ñandú ßtraße",
    "数字 123 ４５６ ٣٤", "🙂🙂 emoji👩‍👩‍👧", " nbsp em　wide\u0085nel", "\x00\x1c\x1f control", "a" * 1000,
    "ab" * 700 + " " + "http://x.y/?q=" + "%20" * 90, "<|endoftext|> is text", "word " * 3000, "é combining", "𝔘nicode",
]


@pytest.fixture(scope="module")
def merges():
    return SW.load_merges(TOKENIZER_FILE)


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(TOKENIZER_FILE)
    made.encode_special_tokens = True
    return made


def test_equal_to_the_library(spark, merges, library):
    """Every document of the small table, token by token, and texts that are hard to cut."""
    texts = [r["text"] for r in scan_documents(spark, f"{SMALL}/documents.parquet").select("text").collect()] + ODD
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["tokens"], r["n"]) for r in SW.tokenize_subwords(docs, merges, SUBWORD_SEPARATOR).collect()}
    for i, encoding in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        expected = [*encoding.ids, SUBWORD_SEPARATOR]
        assert found[i] == (expected, len(expected)), (i, (texts[i] or "")[:80])
    assert found[-1] == ([SUBWORD_SEPARATOR], 1)


def test_heap_and_scan_agree(merges):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice(["the", "ing", "an", "x", "é", "qu", "tion", "s"]) for _ in range(rng.randint(1, 60))).encode()
        ids = [merges.single[b] for b in piece]
        assert merges._by_heap(ids) == merges._by_scan(ids)


def test_round_trip(merges, library):
    for text in ODD:
        ids = [x for p in SW.regex.findall(SW.PIECES, text) for x in merges.encode(p.encode())]
        assert library.decode(ids, skip_special_tokens=False) == text


def test_memo_is_bounded(spark, merges, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} other{i} the the") for i in range(50)], "doc_id bigint, text string")
    whole = sorted(map(tuple, SW.tokenize_subwords(docs, merges).select("doc_id", "n").collect()))
    monkeypatch.setattr(SW, "MEMO_BYTES", 1)
    assert sorted(map(tuple, SW.tokenize_subwords(docs, merges).select("doc_id", "n").collect())) == whole


def test_other_vocabularies_are_refused(tmp_path, merges, spark):
    path = tmp_path / "t.json"
    path.write_text('{"pre_tokenizer": null, "model": {"type": "BPE", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError, match="byte-level"):
        SW.load_merges(str(path))
    path.write_text('{"pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}}')
    with pytest.raises(ValueError, match="lacks tokens"):
        SW.load_merges(str(path))
    with pytest.raises(ValueError, match="16 bits"):
        SW.tokenize_subwords(spark.createDataFrame([], "doc_id bigint, text string"), merges, 70000)

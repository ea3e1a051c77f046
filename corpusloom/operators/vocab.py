"""Word vocabulary counted from the documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import FIRST_WORD_ID, MAX_TOKEN_ID, SPECIAL_COUNT, TokenIdentity
from corpusloom.operators.tokenize import TOKEN_PATTERN, in_blocks
from corpusloom.session import materialize

# Fixed value: size of the RoBERTa vocabulary, special tokens included.
DEFAULT_MAX_VOCAB = 50265

# Different tokens that a task counts before it hands its counts on.
COUNTED_AT_ONCE = 1 << 17


def _word_counter():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(TOKEN_PATTERN).findall
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in in_blocks(batch.column(0)):
                counts.update(words(text or ""))
                if len(counts) >= COUNTED_AT_ONCE:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)

    def counted(counts: Counter[str]) -> pa.RecordBatch:
        columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["token", "occurrences"])

    return count


def token_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(token, occurrences).

    Tokens are counted per task, up to ``COUNTED_AT_ONCE`` different ones at a
    time, so no row per token is made and a frequent token doesn't skew the shuffle.
    """
    partial = documents.select(text).mapInArrow(_word_counter(), "token string, occurrences bigint")
    return partial.groupBy("token").agg(F.sum("occurrences").alias("occurrences"))


def _enough(counts: DataFrame, wanted: int) -> int:
    """A power of two such that at least ``wanted`` tokens occur that often, if there are that many.

    Looks at no more than 63 rows, one per power of two.
    """
    power = F.length(F.bin("occurrences")) - 1
    classes = counts.groupBy(power.alias("power")).agg(F.count("*").alias("tokens")).collect()
    seen = 0
    for power, tokens in sorted(((r["power"], r["tokens"]) for r in classes), reverse=True):
        seen += tokens
        if seen >= wanted:
            return 1 << power
    return 1


def build_vocab(documents: DataFrame, max_vocab: int = DEFAULT_MAX_VOCAB, text: str = "text") -> DataFrame:
    """vocab(token, occurrences, token_id): the most frequent tokens, ties in token order.

    The frequency floor leaves only a little more than the kept tokens for
    the final sort, which therefore never sees the corpus's full vocabulary.
    """
    if not SPECIAL_COUNT < max_vocab <= MAX_TOKEN_ID + 1:
        raise ValueError(f"max_vocab must be in ({SPECIAL_COUNT}, {MAX_TOKEN_ID + 1}], got {max_vocab}")
    wanted = max_vocab - SPECIAL_COUNT
    counts = materialize(token_counts(documents, text), "token-counts")
    frequent = counts.where(F.col("occurrences") >= _enough(counts, wanted))
    kept = frequent.orderBy(F.desc("occurrences"), "token").limit(wanted)
    rank = F.row_number().over(Window.orderBy(F.desc("occurrences"), "token"))
    return kept.select("token", "occurrences", (rank + (FIRST_WORD_ID - 1)).alias("token_id"))


def identity_of(vocab: DataFrame) -> TokenIdentity:
    """Header identity: words, the four leading special tokens and <mask> at the end."""
    return TokenIdentity(vocab_size=vocab.count() + SPECIAL_COUNT)

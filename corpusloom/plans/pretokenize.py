"""Documents to shard files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SHARD_PREFIX, TokenIdentity
from corpusloom.operators.stream import first_documents, shards_in_one_shuffle, stream_offsets
from corpusloom.session import materialize, shuffle_width
from corpusloom.sources.documents import scan_documents
from corpusloom.sources.token_shards import qualified, refuse_shards, write_shards

DEFAULT_SHARD_SIZE = 100_000_000


@dataclass(frozen=True)
class Corpus:
    """Tokenized documents, written once, and the length of their stream."""

    doc_tokens: DataFrame
    total_tokens: int

    def pieces(self, key: str = "doc_id") -> DataFrame:
        return stream_offsets(self.doc_tokens, key, partitions=self.shuffle_width())

    def shuffle_width(self) -> int | None:
        return shuffle_width(self.doc_tokens.sparkSession, self.total_tokens)

    def num_shards(self, shard_size: int) -> int:
        return -(-self.total_tokens // shard_size)


def tokenize_corpus(documents: DataFrame, tokenizer: Callable[[DataFrame], DataFrame]) -> Corpus:
    """Tokenizes once and writes the result, which is read more than once after that."""
    doc_tokens = materialize(tokenizer(documents), "doc-tokens")
    total = doc_tokens.agg(F.coalesce(F.sum(F.col("n").cast("bigint")), F.lit(0))).first()[0]
    return Corpus(doc_tokens, total)


def pretokenize(
    spark: SparkSession, documents: DataFrame | str, folder: str, tokenizer: Callable[[DataFrame], DataFrame],
    identity: TokenIdentity, shard_size: int = DEFAULT_SHARD_SIZE, val_shards: int = 0,
    max_docs: int | None = None, prefix: str = SHARD_PREFIX, mode: str = "error",
) -> Corpus:
    """Tokenizes documents and writes their shards; the first ``val_shards`` are for validation.

    A folder that holds shards already is refused before anything is computed,
    unless ``mode`` is "overwrite", which leaves exactly the new ones.
    """
    if mode == "error":
        refuse_shards(qualified(spark, folder), prefix)
    if isinstance(documents, str):
        documents = scan_documents(spark, documents, max_docs)
    else:
        documents = first_documents(documents, max_docs)
    corpus = tokenize_corpus(documents, tokenizer)
    write_corpus(corpus, folder, identity, shard_size, val_shards, prefix, mode)
    return corpus


def write_corpus(
    corpus: Corpus, folder: str, identity: TokenIdentity, shard_size: int = DEFAULT_SHARD_SIZE,
    val_shards: int = 0, prefix: str = SHARD_PREFIX, mode: str = "error",
) -> None:
    """Writes the shards of tokenized documents; tokens move once."""
    placed = shards_in_one_shuffle(
        corpus.doc_tokens, shard_size, corpus.total_tokens, val_shards, prefix, partitions=corpus.shuffle_width()
    )
    write_shards(placed, folder, identity, prefix, mode, placed=True)

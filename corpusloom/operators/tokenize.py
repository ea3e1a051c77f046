"""Text to token ids; every document ends in the separator."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.config import MAX_TOKEN_ID, SEP_ID, UNK_ID
from corpusloom.functions.arrays import bad_ids

# A run of word characters, or any other single visible character.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^ \t\n\rA-Za-z0-9_]"

SALTS = 32

# Texts of an Arrow batch that are Python strings at the same time.
TEXTS_AT_ONCE = 64


def in_blocks(texts: pa.Array, rows: int = TEXTS_AT_ONCE) -> Iterator[str | None]:
    """The texts one by one, of which no more than ``rows`` are Python strings at a time."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


def token_strings(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def _encoder(vocab, sep_id: int, unk_id: int):
    """Splits and looks up in one pass: the lookup needs Python, and text is less to send there than tokens."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        id_of, words = vocab.value.get, re.compile(TOKEN_PATTERN).findall
        # Ids go to one flat array at once: a batch's texts and tokens are never all held as Python objects.
        flat, ends = array("i"), [0]
        for text in in_blocks(texts):
            flat.extend([id_of(w, unk_id) for w in words(text or "")])
            flat.append(sep_id)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))

    return encode


def tokenizer(
    vocab: DataFrame, key: str = "doc_id", text: str = "text", sep_id: int = SEP_ID, unk_id: int = UNK_ID
) -> Callable[[DataFrame], DataFrame]:
    """``tokenize`` with a vocabulary that is sent to the workers once, for all tables it is called on."""
    ids = {r["token"]: r["token_id"] for r in vocab.select("token", "token_id").collect()}
    if len(ids) > MAX_TOKEN_ID + 1:
        raise ValueError(f"Token ids must fit in uint16, but the vocabulary has {len(ids)} tokens")
    encode = _encoder(vocab.sparkSession.sparkContext.broadcast(ids), sep_id, unk_id)

    def run(documents: DataFrame) -> DataFrame:
        tokens = documents.select(key, encode(F.col(text)).alias("tokens"))
        return tokens.select(key, "tokens", F.size("tokens").alias("n"))

    return run


def tokenize(
    documents: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text",
    sep_id: int = SEP_ID, unk_id: int = UNK_ID,
) -> DataFrame:
    """doc_tokens(key, tokens, n) with the word vocabulary, one row per document.

    A vocabulary has at most 65,536 rows, the bound of the shards' token ids, so
    it is sent to the workers.
    """
    return tokenizer(vocab, key, text, sep_id, unk_id)(documents)


def tokenize_by_join(
    documents: DataFrame, vocab: DataFrame, key: str = "doc_id", text: str = "text",
    sep_id: int = SEP_ID, unk_id: int = UNK_ID,
) -> DataFrame:
    """As ``tokenize``, with a shuffled lookup; salts spread tokens that are a large share of the text.

    Documents with the same key stay two rows.
    """
    numbered = documents.select(key, text, F.monotonically_increasing_id().alias("row"))
    words = numbered.select(key, "row", F.posexplode_outer(token_strings(F.col(text))).alias("at", "token"))
    words = words.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    salted = vocab.select(
        "token", "token_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    known = words.join(salted.hint("shuffle_merge"), ["token", "salt"], "left")
    placed = F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("token_id", F.lit(unk_id)).alias("id")))
    grouped = known.groupBy("row", key).agg(F.sort_array(F.collect_list(placed)).alias("placed"))
    tokens = F.concat(F.transform("placed", lambda p: p["id"]), F.array(F.lit(sep_id)))
    return grouped.select(key, tokens.alias("tokens")).select(key, "tokens", F.size("tokens").alias("n"))


def tokenize_with_file(
    documents: DataFrame, tokenizer_json: str, sep_token: str = "</s>", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """As ``tokenize``, with a user's ``tokenizers`` JSON file, loaded once per Python worker."""
    context = documents.sparkSession.sparkContext
    context.addFile(tokenizer_json)
    name = tokenizer_json.rstrip("/").rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        sep_id = tokenizer.token_to_id(sep_token)
        if sep_id is None:
            raise ValueError(f"Separator {sep_token!r} is not in the tokenizer's vocabulary")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = tokenizer.encode_batch(texts, add_special_tokens=False)
            tokens = pa.array([e.ids + [sep_id] for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], names=[key, "tokens"])

    source = documents.select(key, text)
    key_type = source.schema[key].dataType.simpleString()
    tokens = source.mapInArrow(encode, f"{key} {key_type}, tokens array<int>")
    return tokens.select(key, "tokens", F.size("tokens").alias("n"))


def range_violations(doc_tokens: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Documents with ids that don't fit in 16 bits, and how many."""
    counted = doc_tokens.select(key, F.size(bad_ids(F.col(tokens))).cast("bigint").alias("violations"))
    return counted.where("violations > 0")

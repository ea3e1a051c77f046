"""Byte-pair tokens of a given vocabulary.

A text is cut into pieces, a piece into its UTF-8 bytes, and neighbouring tokens
are merged, always the pair that the vocabulary ranks first, until no ranked pair
is left. Vocabulary and ranks come from a file; they are never learned here.

Pieces repeat, so a task merges each piece once and remembers it, up to
``MEMO_BYTES``. Documents aren't shuffled: what a task learns about its own
pieces costs less than sending every piece to the task that owns it.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import MAX_TOKEN_ID
from corpusloom.operators.tokenize import in_blocks
from corpusloom.session import ship_package

# Fixed pattern of the pieces of byte-level vocabularies.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
MEMO_BYTES = 64 << 20
# Longer pieces are merged by a heap, and not remembered.
LONG_PIECE = 128
# Above every pair's rank and token.
UNRANKED = 1 << 62


@dataclass(frozen=True)
class Merges:
    """``single`` has each byte's token, ``ranks`` the rank and the token of each pair of tokens that merges."""

    single: tuple[int, ...]
    ranks: dict[tuple[int, int], tuple[int, int]]

    def encode(self, piece: bytes) -> list[int]:
        ids = [self.single[b] for b in piece]
        return self._by_heap(ids) if len(ids) > LONG_PIECE else self._by_scan(ids)

    @cached_property
    def _codes(self) -> dict[tuple[int, int], int]:
        """Rank and token of each pair as one number, which is quick to compare."""
        return {pair: rank << 16 | token for pair, (rank, token) in self.ranks.items()}

    def _by_scan(self, ids: list[int]) -> list[int]:
        """Only the pairs beside a merge are looked up again."""
        code = self._codes.get
        pairs = [code(pair, UNRANKED) for pair in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != UNRANKED:
            i, token = pairs.index(best), best & 0xFFFF
            ids[i : i + 2] = [token]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = code((token, ids[i + 1]), UNRANKED)
            if i:
                pairs[i - 1] = code((ids[i - 1], token), UNRANKED)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n: pairs by rank, then place, over a list linked both ways."""
        ids, n = list(ids), len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(*self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, token, i, left, right = heapq.heappop(heap)
            j = after[i]
            # Entries whose tokens have merged since are stale.
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = token, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (pair := (ids[a], ids[after[a]])) in self.ranks:
                    heapq.heappush(heap, (*self.ranks[pair], a, *pair))
        return [x for x, here in zip(ids, alive) if here]


def _byte_signs() -> dict[str, int]:
    """The sign that a byte has in the file: itself if it can be printed, else one from 256 on, in order."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}


def load_merges(path: str) -> Merges:
    """Vocabulary and merges of a ``tokenizers`` JSON file of a byte-level byte-pair model."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model = read["model"]
    if model["type"] != "BPE" or (read.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or read.get("normalizer"):
        raise ValueError(f"{path} holds no plain byte-level byte-pair vocabulary")
    vocab, signs = model["vocab"], _byte_signs()
    missing = [s for s in signs if s not in vocab]
    if missing:
        raise ValueError(f"{path} lacks tokens for {len(missing)} bytes")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
    return Merges(tuple(vocab[s] for s, _ in sorted(signs.items(), key=lambda x: x[1])), ranks)


def _tokenize(shipped, separator: int | None):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cut = shipped.value, regex.compile(PIECES).findall
        known: dict[str, list[int]] = {}
        held = 0
        for batch in batches:
            # Ids go to one flat array at once, and no more than a few texts are Python strings at a time.
            flat, ends = array("i"), [0]
            for text in in_blocks(batch.column("text")):
                for piece in cut(text or ""):
                    found = known.get(piece)
                    if found is None:
                        found = array("i", merges.encode(piece.encode()))
                        if len(piece) <= LONG_PIECE:
                            held += 200 + 4 * len(piece) + 4 * len(found)
                            if held > MEMO_BYTES:
                                known, held = {}, 0
                            known[piece] = found
                    flat += found
                if separator is not None:
                    flat.append(separator)
                ends.append(len(flat))
            sizes, ids = np.diff(np.array(ends, np.int32)), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(sizes)],
                ["id", "tokens", "n"],
            )

    return tokenize


def tokenize_subwords(
    documents: DataFrame, merges: Merges, separator: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_tokens(key, tokens, n): the text's tokens, then the separator if there is one. A null text is empty.

    The vocabulary is sent to every task; its ids fit in 16 bits, so it is bounded.
    """
    top = max(max(merges.single), max((t for _, t in merges.ranks.values()), default=0), separator or 0)
    if top > MAX_TOKEN_ID:
        raise ValueError(f"Token {top} doesn't fit in 16 bits")
    spark = documents.sparkSession
    ship_package(spark)
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(merges)
    found = rows.mapInArrow(_tokenize(shipped, separator), f"id {kind}, tokens array<int>, n int")
    return found.withColumnRenamed("id", key)

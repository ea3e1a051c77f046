"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where no child fits, a node knows
how many pieces are popped off its front and which node the rest of it leads to.
So a word's number of greedy longest-match pieces comes from one walk over its
characters, without backing up and without building pieces. A word is walked
once per task while the table of known words has room; the others only add up.

Pieces are those of a vocabulary file whose word-initial pieces carry a mark. A
word that can't be cut into pieces counts as one unknown token.

Defined results: words are separated by ASCII white space; a null, empty or
blank text has no words and no tokens. Every row is counted for itself, repeated
ones too; ids may be null. Empty tables give empty results. Only the columns
asked for are read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_package

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Words that a task remembers.
MEMORY = 1 << 19
_UNKNOWN = 1 << 32


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model, a tokenizer's JSON file or a text file with a piece a line.

    Word-initial pieces begin with ``MARK``; in a text file, pieces that go on a word begin with ``##``.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.IsControl, model.IsUnknown, model.IsByte)
        return [model.IdToPiece(i) for i in range(len(model)) if not any(test(i) for test in special)]
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            return list(json.load(file)["model"]["vocab"])
    with open(path, encoding="utf-8") as file:
        lines = [line.rstrip("\n") for line in file]
    return [x[2:] if x.startswith("##") else MARK + x for x in lines if x]


class Automaton:
    """The trie: children by (node, character), failure links and popped-token counts by node."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    ends.append(False)
                node = self.children[node][c]
            ends[node] = node > 0
        # -1: what was read can't be cut into pieces.
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.children[parent].items():
                queue.append(node)
                if ends[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                back, count = self.fail[parent], self.popped[parent]
                while back >= 0 and c not in self.children[back]:
                    count += self.popped[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.popped[node] = self.children[back][c], count

    def pieces(self, word: str) -> int | None:
        """Number of greedy longest-match pieces of a word, None if there is no such cut."""
        node, count = 0, 0
        for c in word:
            while c not in self.children[node]:
                count += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return None
            node = self.children[node][c]
        while node > 0:
            count += self.popped[node]
            node = self.fail[node]
        return count if node == 0 else None


def _count(automaton, mark: str, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, known = automaton.value, {}
        for batch in batches:
            counts: list[tuple[int, int, int]] = []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                if len(known) > memory:
                    known = {}
                for word in set(words).difference(known):
                    found = rules.pieces(mark + word.decode())
                    # The upper half counts unknown words.
                    known[word] = _UNKNOWN + 1 if found is None else found
                unknown, tokens = divmod(sum(map(known.__getitem__, words)), _UNKNOWN)
                counts.append((len(words), tokens, unknown))
            columns = [pa.array(x, pa.int64()) for x in zip(*counts)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
    mark: str = MARK,
    memory: int = MEMORY,
) -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)`` of every row. Only the driver reads the file; tasks get the automaton."""
    spark = docs.sparkSession
    ship_package(spark)
    automaton = spark.sparkContext.broadcast(Automaton(read_pieces(vocabulary)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count(automaton, mark, memory), f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")

"""Extends a token corpus from a stream of documents.

Every micro-batch goes to the end of the token stream, its documents in key
order. A shard is written as soon as it is full; ``flush`` writes the tail.

Folders below ``out_dir``: ``tokens`` and ``pieces`` with one subfolder per
micro-batch, ``commits`` with a small file per batch, its place in the stream, and
``shards``. A commit also names the first batch that reaches into the open shard.
What lies wholly in full shards is deleted, and so are all commits but the last
``KEPT_COMMITS``: the state is the open shard's tokens and a few numbers, however
long the stream. The newest commit is found by the files' names alone, and a
commit is put once, whole. A repeated batch takes its start from the commit before
it and overwrites its own folders, so it leaves the same result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import SHARD_PREFIX, TokenIdentity
from corpusloom.operators.stream import shard_pieces, stream_offsets
from corpusloom.session import delete_path
from corpusloom.sources.manifest import put_new
from corpusloom.sources.token_shards import filesystem, qualified, write_shards

PIECE_SCHEMA = "batch_id bigint, shard_index int, split string, name string, start bigint, tokens array<int>"
# A stream repeats its last batch at most; the commit before that is its start.
KEPT_COMMITS = 3
COMMIT_NAME = re.compile(r"^batch_(\d+)\.json$")


class CommitLog:
    """Numbers that each batch left, in files of their own; only the newest are kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.fs, self.root = filesystem(qualified(spark, path))

    def batches(self) -> list[int]:
        """Batches with a commit, ascending."""
        if self.fs.get_file_info(self.root).type != pafs.FileType.Directory:
            return []
        names = (i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.root)))
        return sorted(int(m[1]) for m in map(COMMIT_NAME.match, names) if m)

    def _path(self, batch_id: int) -> str:
        return f"{self.root}/batch_{batch_id}.json"

    def read(self, batch_id: int) -> dict | None:
        if self.fs.get_file_info(self._path(batch_id)).type != pafs.FileType.File:
            return None
        with self.fs.open_input_file(self._path(batch_id)) as f:
            return json.loads(f.read())

    def newest(self, below: int | None = None) -> dict | None:
        """The newest commit, before batch ``below`` if that is given, with its ``batch_id``."""
        known = [b for b in self.batches() if below is None or b < below]
        return self.read(known[-1]) | {"batch_id": known[-1]} if known else None

    def put(self, batch_id: int, numbers: dict) -> None:
        """Adds a batch's commit and drops those that no repeated batch needs."""
        self.fs.create_dir(self.root, recursive=True)
        put_new(self.fs, self._path(batch_id), json.dumps(numbers).encode())
        for old in self.batches()[:-KEPT_COMMITS]:
            self.fs.delete_file(self._path(old))


@dataclass
class IncrementalPacker:
    out_dir: str
    tokenizer: Callable[[DataFrame], DataFrame]
    identity: TokenIdentity
    shard_size: int = 100_000_000
    val_shards: int = 0
    prefix: str = SHARD_PREFIX
    key: str = "doc_id"

    @property
    def shard_dir(self) -> str:
        return f"{self.out_dir}/shards"

    def start(self, documents: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Runs until the stream's present end, unless ``trigger`` says otherwise."""
        writer = documents.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def process(self, documents: DataFrame, batch_id: int) -> None:
        spark = documents.sparkSession
        log = self._log(spark)
        if log.read(batch_id) is not None:
            return
        before = log.newest(below=batch_id)
        start, open_from = (before["end"], before["open_from"]) if before else (0, batch_id)
        tokens_path = f"{self.out_dir}/tokens/batch_id={batch_id}"
        tokenized = self.tokenizer(documents)
        tokenized.write.mode("overwrite").parquet(tokens_path)
        tokens = spark.read.schema(tokenized.schema).parquet(tokens_path)
        added = tokens.agg(F.coalesce(F.sum(F.col("n").cast("bigint")), F.lit(0))).first()[0]
        end = start + added

        placed = stream_offsets(tokens, self.key)
        moved = placed.withColumns({"start": F.col("start") + start, "end": F.col("end") + start})
        cut = shard_pieces(moved, self.shard_size, end, self.val_shards, self.prefix)
        # In shard order, not in a folder per shard: the number of files follows the tasks, and a file's
        # statistics tell which shards it has.
        pieces = cut.select("shard_index", "split", "name", "start", "tokens").repartition("shard_index")
        pieces.sortWithinPartitions("shard_index", "start").write.mode("overwrite").parquet(self._pieces(batch_id))

        first, last = start // self.shard_size, end // self.shard_size
        if last > first:
            self._write(spark, self._read(spark, open_from, batch_id, first, last), self.shard_size)
        still_open = batch_id if last > first else open_from
        log.put(batch_id, {"start": start, "end": end, "open_from": still_open})
        for done in range(open_from, still_open):
            delete_path(spark, self._pieces(done))
        delete_path(spark, tokens_path)

    def flush(self, spark: SparkSession) -> None:
        """Writes the shard that isn't full yet, if it has any token."""
        newest = self._log(spark).newest()
        if newest is None:
            return
        tail, rest = divmod(newest["end"], self.shard_size)
        if rest:
            pieces = self._read(spark, newest["open_from"], newest["batch_id"], tail, tail + 1)
            self._write(spark, pieces, rest)

    def _read(self, spark: SparkSession, first_batch: int, last_batch: int, first: int, last: int) -> DataFrame:
        """(shard_index, split, name, start, tokens) of shards [first, last) in these batches."""
        reader = spark.read.schema(PIECE_SCHEMA).option("basePath", f"{self.out_dir}/pieces")
        found = reader.parquet(*[self._pieces(i) for i in range(first_batch, last_batch + 1)])
        return found.where(F.col("shard_index").between(first, last - 1)).drop("batch_id")

    def _pieces(self, batch_id: int) -> str:
        return f"{self.out_dir}/pieces/batch_id={batch_id}"

    def _log(self, spark: SparkSession) -> CommitLog:
        return CommitLog(spark, f"{self.out_dir}/commits")

    def _write(self, spark: SparkSession, pieces: DataFrame, tokens: int) -> None:
        counted = pieces.withColumn("shard_tokens", F.lit(tokens).cast("bigint"))
        write_shards(counted, self.shard_dir, self.identity, self.prefix)

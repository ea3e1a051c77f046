"""A stream over a shard folder that grows: each window of a split once, as soon as its last token is there.

The offset is how many windows the newest generation of the folder holds, with
what it was counted on: the number of whole shards and a digest of their names,
sizes and checksums. So a restarted stream goes on where its checkpoint says, and
a folder whose earlier shards were replaced is an error, not a mix of two corpora.
A shard that isn't full may be written again while it is the last one, as the tail
of a corpus is; its windows count once a later shard follows it, or with
``includeTail`` at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.config import SHARD_PREFIX, WindowConfig
from corpusloom.sources.token_shards import (
    SCHEMAS,
    ShardFile,
    ShardReader,
    check_contiguous,
    list_shards,
    qualified,
    register,
)

FORMAT = "token_shard_stream"


def digest(shards: list[ShardFile]) -> str:
    listed = "".join(f"{s.name} {s.size} {s.crc32}\n" for s in shards)
    return hashlib.sha256(listed.encode()).hexdigest()


class ShardStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.include_tail = options.get("includeTail", "false").lower() == "true"
        self.reader = ShardReader(options)
        self.reader.mode = "windows"

    def _shards(self) -> list[ShardFile]:
        """The shards that count: all but the last, which may still be replaced."""
        try:
            shards = list_shards(self.reader.folder, self.reader.split, self.reader.prefix)
        except FileNotFoundError:
            return []
        check_contiguous(shards)
        return shards if self.include_tail else shards[:-1]

    def initialOffset(self) -> dict:
        return {"windows": 0, "shards": 0, "digest": digest([])}

    def latestOffset(self) -> dict:
        shards = self._shards()
        window = self.reader.window
        tokens = sum(s.token_count for s in shards)
        count = max(tokens - window.offset(self.reader.epoch), 0) // window.max_seq_length
        return {"windows": count, "shards": len(shards), "digest": digest(shards)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        shards = self._shards()
        for offset in (start, end):
            if digest(shards[: offset["shards"]]) != offset["digest"]:
                raise ValueError(f"Shards of {self.reader.folder} that the stream has read were replaced")
        self.reader.first, self.reader.last = start["windows"], end["windows"]
        return self.reader._window_partitions(shards[: end["shards"]])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class TokenShardStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS["windows"]

    def streamReader(self, schema: StructType) -> ShardStreamReader:
        if "split" not in self.options:
            raise ValueError("A stream of windows reads one split; name it")
        return ShardStreamReader(self.options)


def stream_windows(
    spark: SparkSession, folder: str, split: str, config: WindowConfig, epoch: int = 0, prefix: str = SHARD_PREFIX,
    include_tail: bool = False,
) -> DataFrame:
    """Streaming ``windows(epoch, seq_idx, input_ids)`` of a split of a folder that writers add shards to."""
    register(spark)
    spark.dataSource.register(TokenShardStream)
    options = {
        "split": split,
        "prefix": prefix,
        "epoch": epoch,
        "seqLength": config.max_seq_length,
        "strategy": config.sampling_strategy,
        "phases": config.num_offset_phases,
        "includeTail": str(include_tail).lower(),
    }
    return spark.readStream.format(FORMAT).options(**options).load(qualified(spark, folder))

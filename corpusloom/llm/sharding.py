"""Contiguous shards of even byte size.

Rows are put in id order by ranges. Each range's total is known first; a
running sum over the ranges' totals gives every range its place in the global
byte sequence, a running sum within the range gives every row its own. The
sequence of all bytes is cut at equal targets, and a row goes to the shard that
holds its middle byte. So shards are contiguous in id order, and a shard's size
misses the target by no more than the rows on its two edges.

Defined results: a null text has no bytes; null ids come first; rows with equal
ids are ordered by checksum and size, and repeated rows take one place each (it
doesn't matter which, as they are equal). An empty table gives an empty result.
Only the columns asked for are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import wide
from corpusloom.session import materialize

OVERHEAD = 16
ROWS_PER_TASK = 1 << 20
# Broadcast limits: one row per range or shard, so far below what a driver holds.
MAX_SHARDS = 1 << 20


def text_bytes(text: Column, overhead: int = OVERHEAD) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed part per row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows ``(key, size, crc, ...)`` with ``before``, the bytes before the row, ``row``, its number, and ``total``."""
    n = rows.count()
    ranges = wide(rows, n, ROWS_PER_TASK)
    # Equal rows would share one range; their places in the scan tell them apart.
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(ranges, "key", "crc", "size", "tie")
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "byte-ranges")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row per range.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("range_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("range_row"),
        F.sum("bytes").over(whole).alias("total"),
    )
    within = Window.partitionBy("range").orderBy("key", "crc", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.select(
        "*",
        (F.sum("size").over(within) - F.col("size")).alias("inner_before"),
        (F.count("*").over(within) - 1).alias("inner_row"),
    )
    return placed.join(F.broadcast(starts), "range").select(
        *rows.columns,
        (F.col("range_before") + F.col("inner_before")).alias("before"),
        (F.col("range_row") + F.col("inner_row")).alias("row"),
        "total",
    )


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None
) -> DataFrame:
    """``(key, size, crc, shard, slot)`` of every row, and ``kept`` if a column is to be carried along.

    ``slot`` counts the rows of a shard from 0 in id order.
    """
    if not 0 < shards <= MAX_SHARDS:
        raise ValueError(f"The number of shards must be between 1 and {MAX_SHARDS}, not {shards}")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("key"),
        text_bytes(text).alias("size"),
        text_crc32(text).alias("crc"),
        *([] if keep is None else [keep.alias("kept")]),
    )
    # Exact integers: the products may pass 2^63.
    cut = F.expr(
        f"cast((cast(2 * before + size as decimal(25, 0)) * cast({shards} as decimal(10, 0)))"
        " div greatest(cast(2 * total as decimal(25, 0)), 1) as int)"
    )
    placed = _placed(rows).withColumn("shard", F.least(cut, F.lit(shards - 1)))
    # One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "key",
        "size",
        "crc",
        *([] if keep is None else ["kept"]),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
    )


def write_shards(
    docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", folder_col: str = "shard"
) -> None:
    """Writes whole rows below ``path/shard=n``, in id order within each file.

    A shard of many rows is written by several tasks, one per run of slots. The
    folders' column must not be one of the rows'; ``folder_col`` names another.
    """
    if folder_col.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"The rows have a column {folder_col!r} of their own; name the folders' column with folder_col")
    rows = assign_shards(docs, shards, id_col, text_col, keep=F.struct(*[F.col(c) for c in docs.columns]))
    n = wide(docs, rows.count(), ROWS_PER_TASK)
    columns = [F.col(f"kept.{c}").alias(c) for c in docs.columns]
    placed = rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select(*columns, F.col("shard").alias(folder_col)).write.partitionBy(folder_col).parquet(path)

"""Checks and lookups over the shard catalog."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusloom.config import TokenIdentity
from corpusloom.operators.prefix import running_sums
from corpusloom.session import materialize
from corpusloom.sources.token_shards import HEADER_FIELDS, read_headers

# Shards of one split must agree in all of these.
FORMAT_FIELDS = tuple(f for f in HEADER_FIELDS if f != "token_count")

# The run's vocabulary must match these; cls_id is only reported.
CHECKED_IDENTITY = ("vocab_size", "pad_id", "sep_id", "mask_id")

# 48 MB of shard positions go to every worker at once.
MAX_SHIPPED_SHARDS = 1 << 22

# Shard indexes are INT.
MAX_INDEX = 1 << 31


def shard_offsets(headers: DataFrame) -> DataFrame:
    """shards(split, shard_index, name, token_start, token_end, header): each split is one stream."""
    counted = headers.withColumn("shard_index", F.col("shard_index").cast("bigint"))
    placed = running_sums(
        counted, "shard_index", {"n": F.col("header.token_count").cast("bigint")}, by=["split"], bits=15,
        buckets=MAX_INDEX >> 15,
    )
    start = F.col("before_n")
    return placed.select(
        "split",
        F.col("shard_index").cast("int").alias("shard_index"),
        "name",
        start.alias("token_start"),
        (start + F.col("header.token_count")).alias("token_end"),
        "header",
    )


def split_totals(headers: DataFrame) -> DataFrame:
    return headers.groupBy("split").agg(
        F.count("*").alias("num_shards"), F.sum(F.col("header.token_count").cast("bigint")).alias("total_tokens")
    )


def inconsistent_headers(headers: DataFrame) -> DataFrame:
    """(name, field, value, expected): fields that differ from the split's first shard."""
    first = headers.groupBy("split").agg(F.min_by("header", "name").alias("first"))
    pairs = [
        F.struct(
            F.lit(f).alias("field"), F.col(f"header.{f}").alias("value"), F.col(f"first.{f}").alias("expected")
        )
        for f in FORMAT_FIELDS
    ]
    # One row per split.
    compared = headers.join(F.broadcast(first), "split").select("name", F.inline(F.array(*pairs)))
    return compared.where("value != expected")


def compare_identity(headers: DataFrame, identity: TokenIdentity) -> DataFrame:
    """(name, field, header_value, vocab_value, status) with status ok, mismatch or warning."""
    rows = [
        F.struct(
            F.lit(f).alias("field"),
            F.col(f"header.{f}").alias("header_value"),
            F.lit(getattr(identity, f)).alias("vocab_value"),
            F.lit(f in CHECKED_IDENTITY).alias("checked"),
        )
        for f in (*CHECKED_IDENTITY, "cls_id")
    ]
    flat = headers.select("name", F.inline(F.array(*rows)))
    equal = F.col("header_value") == F.col("vocab_value")
    status = F.when(equal, "ok").when(F.col("checked"), "mismatch").otherwise("warning")
    return flat.select("name", "field", "header_value", "vocab_value", status.alias("status"))


def open_shards(
    spark: SparkSession, folder: str, split: str, identity: TokenIdentity | None = None, **options
) -> DataFrame:
    """The split's catalog, after all checks; raises FileNotFoundError or ValueError."""
    headers = read_headers(spark, folder, split, **options)
    fields = [F.col(f"header.{f}").alias(f) for f in FORMAT_FIELDS]
    formats = headers.groupBy(*fields).agg(F.min("name").alias("name")).orderBy("name").limit(2).collect()
    if len(formats) > 1:
        first, other = formats
        field = next(f for f in FORMAT_FIELDS if first[f] != other[f])
        raise ValueError(f"{field} isn't the same in all shards: {first['name']} has {first[field]}, {other['name']} {other[field]}")
    for field in CHECKED_IDENTITY if identity is not None and formats else ():
        if formats[0][field] != getattr(identity, field):
            raise ValueError(f"The shards were made with {field} {formats[0][field]}, not {getattr(identity, field)}")
    return shard_offsets(headers)


def _last_start(starts) -> Column:
    @F.arrow_udf(LongType())
    def find(positions: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(starts.value, positions.to_numpy(), side="right") - 1)

    return find


def locate(positions: DataFrame, shards: DataFrame, position: str = "position") -> DataFrame:
    """Adds (shard_index, local_offset): the last shard that starts at or before the position.

    ``shards`` holds one split. Empty shards contain no position. The shards'
    starts are searched in memory, so nothing is shuffled and no position is more
    frequent than another. A catalog of more than ``MAX_SHIPPED_SHARDS`` isn't
    read by the driver but merged with the positions, see ``locate_merged``.
    """
    filled = shards.where("token_end > token_start").select("token_start", "token_end", "shard_index")
    if filled.count() > MAX_SHIPPED_SHARDS:
        return locate_merged(positions, shards, position)
    return _locate_in(positions, filled.orderBy("token_start").toArrow(), position)


def locate_merged(positions: DataFrame, shards: DataFrame, position: str = "position") -> DataFrame:
    """As ``locate``, for catalogs of any size: shards and positions are merged in order.

    Both are range-partitioned together by place, so that a place many rows share
    is cut into ranges too. Within a range each position takes the last shard
    before it; a range's first positions take the last shard of the ranges before,
    which is one row per range.
    """
    spark = positions.sparkSession
    starts = shards.where("token_end > token_start").select(
        F.col("token_start").alias("at"),
        F.struct("token_start", "token_end", F.col("shard_index").cast("int").alias("shard_index")).alias("shard"),
        F.lit(None).cast(positions.schema).alias("row"),
    )
    rows = positions.select(
        F.col(position).cast("bigint").alias("at"),
        F.lit(None).cast("struct<token_start:bigint,token_end:bigint,shard_index:int>").alias("shard"),
        F.struct(*[F.col(c) for c in positions.columns]).alias("row"),
    )
    # At the same place a shard's start comes first; ties are told apart by their place in the scan.
    both = starts.unionByName(rows).where(F.col("at").isNotNull())
    both = both.withColumn("late", F.col("row").isNotNull()).withColumn("tie", F.monotonically_increasing_id())
    order = ["at", "late", "tie"]
    ranged = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "places")
    lasts = ranged.groupBy("range").agg(F.max_by("shard", F.when(F.col("shard").isNotNull(), F.col("at"))).alias("last"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("range", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    sofar = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("own", F.last("shard", ignorenulls=True).over(sofar)).where("late").join(carried, "range")
    placed = found.select("row", "at", F.coalesce("own", "carried").alias("s")).where(F.col("at") < F.col("s.token_end"))
    return placed.select(
        *[F.col(f"row.{c}").alias(c) for c in positions.columns],
        F.col("s.shard_index").alias("shard_index"),
        (F.col("at") - F.col("s.token_start")).alias("local_offset"),
    )


def _locate_in(positions: DataFrame, table: pa.Table, position: str) -> DataFrame:
    context = positions.sparkSession.sparkContext
    starts = table["token_start"].to_numpy()
    shipped, indexes = context.broadcast(starts), context.broadcast(table["shard_index"].to_numpy())
    begin, end = (int(starts[0]), int(table["token_end"].to_numpy()[-1])) if len(starts) else (0, 0)

    @F.arrow_udf(LongType())
    def shard_of(at: pa.Array) -> pa.Array:
        return pa.array(indexes.value[at.to_numpy()].astype(np.int64))

    @F.arrow_udf(LongType())
    def start_of(at: pa.Array) -> pa.Array:
        return pa.array(shipped.value[at.to_numpy()])

    inside = positions.where(F.col(position).between(begin, end - 1))
    found = inside.withColumn("_at", _last_start(shipped)(F.col(position)))
    return found.select(
        *positions.columns,
        shard_of("_at").cast("int").alias("shard_index"),
        (F.col(position) - start_of("_at")).alias("local_offset"),
    )

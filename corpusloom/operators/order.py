"""Order of the samples: permutation, resume, ranks and batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.draws import PERMUTE, sort_key
from corpusloom.functions.scalars import idiv
from corpusloom.operators.prefix import bucket_sums

KEY_BITS = 60
ROWS_PER_BUCKET = 2**17
SAMPLES_PER_BUCKET = 2**10


def _keyed(samples: DataFrame, seed: int, epoch: int, hash_fn: str) -> DataFrame:
    return samples.withColumn("key", sort_key(hash_fn, PERMUTE, seed + epoch, F.col("seq_idx")))


def permute(
    samples: DataFrame, num_samples: int, seed: int, epoch: int, hash_fn: str = "xxhash64",
    rows_per_bucket: int | None = None, partitions: int | None = None,
) -> DataFrame:
    """Adds ``pos`` to all samples 0..N-1, whatever else they carry: a shuffle that seed + epoch decides.

    Samples are ranked by a random key: the key's top bits split them into even
    buckets, each of which is ranked in its own task. So a sample moves once, and
    then lies next to those with neighbouring positions.
    """
    per_bucket = rows_per_bucket or SAMPLES_PER_BUCKET
    bits = max(0, math.ceil(math.log2(max(num_samples, 1) / per_bucket)))
    shift = KEY_BITS - bits
    ids = samples.sparkSession.range(num_samples).select(F.col("id").alias("seq_idx"))
    bases = bucket_sums(
        _keyed(ids, seed, epoch, hash_fn), "key", {"rows": F.lit(1).cast("bigint")}, bits=shift, buckets=1 << bits
    ).select("bucket", "before_rows")
    keyed = _keyed(samples, seed, epoch, hash_fn).withColumn("bucket", F.shiftright("key", shift))
    if partitions:
        keyed = keyed.repartition(partitions, "bucket")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "seq_idx")) - 1
    ranked = keyed.withColumn("rank_in_bucket", rank).join(bases, "bucket")
    return ranked.select(*samples.columns, (F.col("rank_in_bucket") + F.col("before_rows")).alias("pos"))


def permutation(
    spark: SparkSession, num_samples: int, seed: int, epoch: int, hash_fn: str = "xxhash64"
) -> DataFrame:
    """order(epoch, seq_idx, pos): the permutation alone."""
    ids = spark.range(num_samples).select(F.lit(epoch).alias("epoch"), F.col("id").alias("seq_idx"))
    return permute(ids, num_samples, seed, epoch, hash_fn, ROWS_PER_BUCKET)


def sequential(spark: SparkSession, num_samples: int, epoch: int = 0) -> DataFrame:
    """The unshuffled order."""
    ids = spark.range(num_samples)
    return ids.select(F.lit(epoch).alias("epoch"), F.col("id").alias("seq_idx"), F.col("id").alias("pos"))


def resume(order: DataFrame, index: int) -> DataFrame:
    """What is left of the epoch after ``index`` samples."""
    return order.where(F.col("pos") >= index)


def rank_stripes(order: DataFrame, num_samples: int, world_size: int, drop_last: bool) -> DataFrame:
    """Adds (rank, local_pos), every rank with the same number of samples.

    With ``drop_last`` the tail is cut; otherwise samples from the start are
    repeated, in whole rounds if there are fewer samples than ranks.
    """
    if drop_last:
        even = order.where(F.col("pos") < num_samples // world_size * world_size)
    else:
        total = -(-num_samples // world_size) * world_size
        places = F.sequence(F.col("pos"), F.lit(total - 1).cast("bigint"), F.lit(max(num_samples, 1)).cast("bigint"))
        even = order.withColumn("pos", F.explode(places))
    return even.withColumns(
        {"rank": F.pmod("pos", F.lit(world_size)).cast("int"), "local_pos": idiv(F.col("pos"), world_size)}
    )


def batches(
    order: DataFrame, num_samples: int, batch_size: int, drop_last: bool = True, pos: str = "pos"
) -> DataFrame:
    """Adds (batch_id, pos_in_batch); ``num_samples`` is per rank where ``pos`` is."""
    kept = order.where(F.col(pos) < num_samples // batch_size * batch_size) if drop_last else order
    return kept.withColumns(
        {"batch_id": idiv(F.col(pos), batch_size), "pos_in_batch": F.pmod(pos, F.lit(batch_size)).cast("int")}
    )

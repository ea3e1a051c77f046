"""Shard files to ordered, masked batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import SHARD_PREFIX, LoaderConfig, MaskConfig, SpanConfig, WindowConfig
from corpusloom.functions.arrays import pad_to
from corpusloom.operators.bijection import Bijection
from corpusloom.operators.objectives import build
from corpusloom.operators.order import batches, permutation, permute, rank_stripes, resume, sequential
from corpusloom.operators.shards import open_shards
from corpusloom.session import shuffle_width
from corpusloom.sources.token_shards import list_shards, read_ordered, read_windows


def num_windows(total_tokens: int, config: WindowConfig, epoch: int = 0) -> int:
    return max(total_tokens - config.offset(epoch), 0) // config.max_seq_length


def shard_window(
    spark: SparkSession, folder: str, split: str, config: WindowConfig, seq_idx: int, epoch: int = 0, **options
) -> DataFrame:
    """One window of a split by index; only its bytes are read."""
    total = sum(s.token_count for s in list_shards(folder, split, options.get("prefix", SHARD_PREFIX)))
    count = num_windows(total, config, epoch)
    if not 0 <= seq_idx < count:
        raise IndexError(f"Index {seq_idx} out of range [0, {count})")
    one = {"firstWindow": seq_idx, "lastWindow": seq_idx + 1, **options}
    return read_windows(spark, folder, split, config, epoch, **one)


def arrange(samples: DataFrame, num_samples: int, config: LoaderConfig, index: int = 0) -> DataFrame:
    """Adds rank, local_pos, batch_id and pos_in_batch to samples with ``pos``, from ``index`` on."""
    left = resume(samples, index).withColumn("pos", F.col("pos") - index)
    remaining = max(num_samples - index, 0)
    world = config.world_size
    striped = rank_stripes(left, remaining, world, config.drop_last and world > 1)
    per_rank = remaining // world if config.drop_last else -(-remaining // world)
    return batches(striped, per_rank, config.batch_size, config.drop_last, pos="local_pos")


def sample_order(
    spark: SparkSession, num_samples: int, config: LoaderConfig, seed: int = 0, epoch: int = 0,
    index: int = 0, hash_fn: str = "xxhash64",
) -> DataFrame:
    """(epoch, seq_idx, pos, rank, local_pos, batch_id, pos_in_batch) from ``index`` on, without the samples."""
    if config.shuffle and config.order == "keyed":
        ids = spark.range(num_samples).select(F.lit(epoch).alias("epoch"), F.col("id").alias("seq_idx"))
        order = ids.withColumn("pos", Bijection(num_samples, seed, epoch, hash_fn).position(F.col("seq_idx")))
    elif config.shuffle:
        order = permutation(spark, num_samples, seed, epoch, hash_fn)
    else:
        order = sequential(spark, num_samples, epoch)
    return arrange(order, num_samples, config, index)


def training_batches(
    spark: SparkSession, folder: str, split: str, objective: str, objective_config: MaskConfig | SpanConfig,
    window_config: WindowConfig | None = None, loader: LoaderConfig | None = None, seed: int = 0, epoch: int = 0,
    index: int = 0, **options,
) -> DataFrame:
    """One row per sample: rank, batch_id, pos_in_batch, seq_idx and the objective's columns.

    Windows are read in place and take their tokens along into the shuffled
    order, which is the only time tokens move; span corruption pads per batch and
    needs a second shuffle. A keyed order moves nothing: each window's place is
    computed, so windows before ``index`` aren't read.
    """
    window_config, loader = window_config or WindowConfig(), loader or LoaderConfig()
    open_shards(spark, folder, split, objective_config.identity, **options)
    total = sum(s.token_count for s in list_shards(folder, split, options.get("prefix", SHARD_PREFIX)))
    count = num_windows(total, window_config, epoch)
    keyed = loader.shuffle and loader.order == "keyed"
    if keyed:
        samples = read_ordered(spark, folder, split, window_config, seed, epoch, objective_config.hash_fn, **options)
    else:
        samples = read_windows(spark, folder, split, window_config, epoch, **options)
    samples = samples.drop("epoch")
    if loader.shuffle and not keyed:
        width = shuffle_width(spark, total)
        samples = permute(samples, count, seed, epoch, objective_config.hash_fn, partitions=width)
    elif not keyed:
        samples = samples.withColumn("pos", F.col("seq_idx"))
    placed = arrange(samples, count, loader, index)
    placed = placed.select("rank", "batch_id", "pos_in_batch", "seq_idx", "input_ids")
    if isinstance(objective_config, SpanConfig):
        return build(objective, placed, objective_config, by=["rank", "batch_id"])
    multiple = max(objective_config.pad_to_multiple_of, 1)
    length = -(-window_config.max_seq_length // multiple) * multiple
    padded = pad_to(F.col("input_ids"), F.lit(length), objective_config.identity.pad_id)
    return build(objective, placed.withColumn("input_ids", padded), objective_config)


def write_batches(samples: DataFrame, path: str, compact: bool = True) -> None:
    """Parquet, one folder per rank, in batch order within each file.

    Samples move once more, so that a rank's batches are few and large files,
    however many tasks and ranks there are. Without ``compact`` they stay where
    they are: for few ranks, as every task then writes a file for each.
    """
    if compact:
        samples = samples.repartitionByRange("rank", "batch_id", "pos_in_batch")
    ordered = samples.sortWithinPartitions("rank", "batch_id", "pos_in_batch")
    ordered.write.partitionBy("rank").parquet(path)

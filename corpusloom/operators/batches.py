"""Padding and batch assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import attention_mask, label_count, pad_to, special_mask
from corpusloom.functions.scalars import round_up


def padded_length(samples: DataFrame, ids: str, by: list[str], multiple: int = 8) -> DataFrame:
    """(by, padded_length): the batch's longest sequence, rounded up."""
    longest = F.max(F.size(ids)).cast("bigint")
    return samples.groupBy(*by).agg(round_up(longest, multiple).alias("padded_length"))


def pad_batches(samples: DataFrame, columns: dict[str, int], by: list[str], multiple: int = 8) -> DataFrame:
    """Right-pads every named array column with its value, to its length in the batch.

    A batch has no more rows than its batch size, so its window is small.
    """
    batch = Window.partitionBy(*by)
    padded = {
        c: pad_to(F.col(c), round_up(F.max(F.size(c)).over(batch).cast("bigint"), multiple), value)
        for c, value in columns.items()
    }
    return samples.withColumns(padded)


def add_masks(samples: DataFrame, identity, ids: str = "input_ids") -> DataFrame:
    """Adds ``attention_mask`` and ``special_mask``."""
    return samples.withColumns(
        {
            "attention_mask": attention_mask(F.col(ids), identity.pad_id),
            "special_mask": special_mask(F.col(ids), identity),
        }
    )


def collate(samples: DataFrame, columns: list[str], by: list[str], order: str = "pos_in_batch") -> DataFrame:
    """One row per batch, each column an array over the batch's samples in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    gathered = samples.groupBy(*by).agg(rows.alias("rows"))
    return gathered.select(*by, *[F.col(f"rows.{c}").alias(c) for c in columns])


def mask_counts(samples: DataFrame, identity, by: list[str], ids: str, labels: str = "labels") -> DataFrame:
    """Per batch: positions to predict, positions that could have been chosen, and their ratio.

    ``ids`` are the original ids, before masking.
    """
    eligible = F.size(F.filter(special_mask(F.col(ids), identity), lambda m: ~m))
    counted = samples.groupBy(*by).agg(
        F.sum(label_count(F.col(labels)).cast("bigint")).alias("num_masked"),
        F.sum(eligible.cast("bigint")).alias("num_eligible"),
    )
    ratio = F.col("num_masked") / F.nullif(F.col("num_eligible"), F.lit(0))
    return counted.withColumn("ratio", ratio)

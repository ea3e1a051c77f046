"""Scalar column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.config import SHARD_PREFIX


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division, as BIGINT."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def epoch_offset(epoch: Column, length: int, phases: int) -> Column:
    return idiv(F.pmod(epoch, F.lit(phases)).cast("bigint") * length, phases)


def round_up(n: Column, multiple: int) -> Column:
    return n if multiple <= 1 else idiv(n + (multiple - 1), multiple) * multiple


def sequence_count(total: Column, offset: Column | int, length: int) -> Column:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return idiv(F.greatest(total - offset, F.lit(0).cast("bigint")), length)


def perplexity(loss: Column) -> Column:
    return F.when(F.isnan(loss), loss).otherwise(F.exp(F.least(loss, F.lit(100.0))))


def shard_name(split: Column, shard_index: Column, prefix: str = SHARD_PREFIX) -> Column:
    return F.format_string("%s_%s_%06d.bin", F.lit(prefix), split, shard_index)


def split_label(shard_index: Column, val_shards: int = 0) -> Column:
    return F.when(shard_index < val_shards, F.lit("val")).otherwise(F.lit("train"))


def _line(pattern: str, step: Column, loss: Column) -> Column:
    """A log line; null without a step or a loss.

    Python does the rounding: Java's formatter rounds the shortest decimal
    form half up, so it differs on ties and beyond 17 digits.
    """

    @F.arrow_udf(StringType())
    def line(steps: pa.Array, losses: pa.Array, perplexities: pa.Array) -> pa.Array:
        rows = zip(steps.to_pylist(), losses.to_pylist(), perplexities.to_pylist())
        return pa.array([None if s is None or x is None else pattern % (s, x, p) for s, x, p in rows], pa.string())

    return line(step, loss, perplexity(loss))


def step_line(step: Column, loss: Column) -> Column:
    """Log line of a training step."""
    return _line("step=%d loss=%.4f ppl=%.2f", step, loss)


def eval_line(step: Column, loss: Column) -> Column:
    return _line("[eval] step=%d eval_loss=%.4f ppl=%.2f", step, loss)

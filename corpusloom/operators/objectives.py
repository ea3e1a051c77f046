"""Training objectives: what a sample's tokens become as inputs and labels.

Random choices are keyed by (seed, epoch, seq_idx, position in the window).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusloom.config import IGNORE_LABEL, MaskConfig, SpanConfig
from corpusloom.functions.arrays import attention_mask, label_mask
from corpusloom.functions.draws import DRAW_RANGE, MASK, SPAN_GAP, SPAN_LENGTH, chosen_of, draw
from corpusloom.operators.batches import pad_batches
from corpusloom.registry import Registry

def masked_labels(ids: Column, seq_idx: Column, config: MaskConfig) -> Column:
    """The original id at chosen positions, the ignored label elsewhere."""
    special = config.identity.special_ids

    def labels(keyed) -> Column:
        return F.transform(ids, lambda x, i: F.when(~x.isin(*special) & keyed(i), x).otherwise(F.lit(IGNORE_LABEL)))

    return chosen_of(labels, config.probability, config.hash_fn, MASK, config.seed, config.epoch, seq_idx)


def _hide(ids: Column, labels: Column, mask_id: int) -> Column:
    return F.zip_with(ids, labels, lambda x, y: F.when(y == IGNORE_LABEL, x).otherwise(F.lit(mask_id)))


def mlm(samples: DataFrame, config: MaskConfig, by: list[str] | None = None) -> DataFrame:
    """input_ids (chosen positions hidden), attention_mask, labels. ``by`` pads per batch first."""
    padded = _padded(samples, config, by)
    attention = attention_mask(F.col("input_ids"), config.identity.pad_id)
    labelled = padded.withColumns(
        {"attention_mask": attention, "labels": masked_labels(F.col("input_ids"), F.col("seq_idx"), config)}
    )
    return labelled.withColumn("input_ids", _hide(F.col("input_ids"), F.col("labels"), config.identity.mask_id))


def electra(samples: DataFrame, config: MaskConfig, by: list[str] | None = None) -> DataFrame:
    """input_ids, masked_input_ids, attention_mask, mlm_labels, is_masked."""
    padded = _padded(samples, config, by)
    labels = masked_labels(F.col("input_ids"), F.col("seq_idx"), config)
    labelled = padded.withColumn("mlm_labels", labels)
    return labelled.withColumns(
        {
            "masked_input_ids": _hide(F.col("input_ids"), F.col("mlm_labels"), config.identity.mask_id),
            "attention_mask": attention_mask(F.col("input_ids"), config.identity.pad_id),
            "is_masked": F.transform("mlm_labels", lambda y: y != IGNORE_LABEL),
        }
    )


def _padded(samples: DataFrame, config: MaskConfig, by: list[str] | None) -> DataFrame:
    if by is None:
        return samples
    return pad_batches(samples, {"input_ids": config.identity.pad_id}, by, config.pad_to_multiple_of)


def span_budget(ids: Column, noise_density: float) -> Column:
    """Number of tokens to take out."""
    return (F.size(ids) * F.lit(float(noise_density))).cast("int")


def _draws(seq_idx: Column, budget: Column, config: SpanConfig) -> tuple[Column, Column]:
    """Drawn span lengths and gap draws, as many as the budget has tokens."""

    def length(k: Column) -> Column:
        if config.mean_span_length <= 1.0:
            return F.lit(1)
        u = draw(config.hash_fn, SPAN_LENGTH, config.seed, config.epoch, seq_idx, k) / F.lit(float(DRAW_RANGE))
        failures = F.floor(F.log(1.0 - u) / F.lit(math.log(1.0 - 1.0 / config.mean_span_length)))
        return F.greatest(failures.cast("int"), F.lit(1))

    def gap(k: Column) -> Column:
        return draw(config.hash_fn, SPAN_GAP, config.seed, config.epoch, seq_idx, k)

    def each(value: Callable[[Column], Column], kind: str) -> Column:
        none = F.array().cast(f"array<{kind}>")
        return F.when(budget > 0, F.transform(F.sequence(F.lit(0), budget - 1), value)).otherwise(none)

    return each(length, "int"), each(gap, "bigint")


def _before(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the earlier values of each row, for rows of these sizes laid end to end."""
    sums = np.concatenate(([0], np.cumsum(values)))
    firsts = np.cumsum(sizes) - sizes
    return sums[:-1] - np.repeat(sums[firsts], sizes)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def place_batch(size: np.ndarray, budget: np.ndarray, drawn: np.ndarray, gaps: np.ndarray):
    """Spans of a batch of sequences, in a few passes over flat arrays.

    ``drawn`` and ``gaps`` hold ``budget`` values per row. Lengths add up to the
    budget, the last one clipped. Each span follows a random gap, until one
    doesn't fit; spans that would cover the whole sequence are first cut to a
    third of its length in number, and where even these leave no room there is
    one span from the start.
    Returns (lengths, their number per row, starts, span lengths, their number per row).
    """
    budget = np.maximum(budget, 0)
    left = np.repeat(budget, budget) - _before(drawn, budget)
    row = np.repeat(np.arange(len(size)), budget)
    taken = left > 0
    lengths, row, gaps = np.minimum(drawn, left)[taken], row[taken], gaps[taken]
    counts = np.bincount(row, minlength=len(size))
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    most = np.where(_row_sums(lengths, counts) >= size, np.maximum(size // 3, 1), counts)
    used = (place < most[row]) & (size[row] > 0)
    in_use, row, gaps = lengths[used], row[used], gaps[used]
    number = np.bincount(row, minlength=len(size))
    room = size - _row_sums(in_use, number)
    widest = np.maximum(room // (number + 1), 1)
    steps = np.where(room[row] > 0, np.mod(gaps, widest[row]), 0)
    start = _before(in_use + steps, number) + steps
    first = np.arange(len(row)) == np.repeat(np.cumsum(number) - number, number)
    crowded = room[row] <= 0
    length = np.where(crowded, np.minimum(in_use, size[row]), in_use)
    kept = np.where(crowded, first, start + length <= size[row])
    return lengths, counts, start[kept], length[kept], np.bincount(row[kept], minlength=len(size))


_SPAN = StructType([StructField("start", IntegerType()), StructField("len", IntegerType())])
SPAN_COLUMNS = StructType(
    [StructField("span_lengths", ArrayType(IntegerType())), StructField("spans", ArrayType(_SPAN))]
)


@F.arrow_udf(SPAN_COLUMNS)
def _placed(size: pa.Array, drawn: pa.Array, gaps: pa.Array) -> pa.Array:
    budget = np.diff(drawn.offsets.to_numpy()).astype(np.int64)
    flat = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (drawn, gaps))
    lengths, counts, start, length, number = place_batch(size.to_numpy().astype(np.int64), budget, *flat)
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32())], ["start", "len"])
    columns = [_lists(pa.array(lengths, pa.int32()), counts), _lists(spans, number)]
    return pa.StructArray.from_arrays(columns, ["span_lengths", "spans"])


def emit_spans(ids: Column, spans: Column, sentinel_start_id: int, num_sentinels: int) -> tuple[Column, Column]:
    """(corrupted, target): each span becomes a sentinel; the target lists sentinels and span tokens.

    Slices between the spans are joined, so the cost grows with the sequence,
    not with sequence times spans. Spans are disjoint and in order.
    """

    def sentinel(k: Column) -> Column:
        return F.array((F.lit(sentinel_start_id) + F.pmod(k, F.lit(num_sentinels))).cast("int"))

    def end_of(k: Column) -> Column:
        before = F.get(spans, k)
        return F.coalesce(before["start"] + before["len"], F.lit(0))

    def kept(s: Column, k: Column) -> Column:
        begin = end_of(k - 1)
        return F.concat(F.slice(ids, begin + 1, s["start"] - begin), sentinel(k))

    def taken(s: Column, k: Column) -> Column:
        return F.concat(sentinel(k), F.slice(ids, s["start"] + 1, s["len"]))

    last = end_of(F.size(spans) - 1)
    rest = F.slice(ids, last + 1, F.size(ids) - last)
    corrupted = F.concat(F.flatten(F.transform(spans, kept)), rest)
    target = F.flatten(F.transform(spans, taken))
    empty = F.size(spans) == 0
    return F.when(empty, ids).otherwise(corrupted), F.when(empty, sentinel(F.lit(0))).otherwise(target)


def sample_spans(samples: DataFrame, config: SpanConfig) -> DataFrame:
    """Adds ``span_lengths`` and ``spans``.

    Draws are column expressions, the same in any engine; what depends on those
    before it is put together for a whole batch at once.
    """
    budget = span_budget(F.col("input_ids"), config.noise_density)
    found = samples.withColumn("placed", _placed(F.size("input_ids"), *_draws(F.col("seq_idx"), budget, config)))
    return found.select(*samples.columns, "placed.span_lengths", "placed.spans")


def replace_spans(samples: DataFrame, config: SpanConfig) -> DataFrame:
    """Turns ``spans`` into the corrupted ``input_ids`` and the target ``labels``."""
    corrupted, target = emit_spans(
        F.col("input_ids"), F.col("spans"), config.sentinel_start_id, config.num_sentinels
    )
    # One by one: within one withColumns, the target would be cut from the corrupted input.
    replaced = samples.withColumn("labels", target).withColumn("input_ids", corrupted)
    return replaced.drop("spans", "span_lengths")


def pad_targets(samples: DataFrame, config: SpanConfig, by: list[str]) -> DataFrame:
    """Pads inputs and targets per batch and adds both attention masks."""
    pad_id = config.identity.pad_id
    padded = pad_batches(
        samples, {"input_ids": pad_id, "labels": IGNORE_LABEL}, by, config.pad_to_multiple_of
    )
    return padded.withColumns(
        {
            "attention_mask": attention_mask(F.col("input_ids"), pad_id),
            "decoder_attention_mask": label_mask(F.col("labels")),
        }
    )


def span_corruption(samples: DataFrame, config: SpanConfig, by: list[str] | None = None) -> DataFrame:
    """input_ids, attention_mask, labels, decoder_attention_mask."""
    corrupted = replace_spans(sample_spans(samples, config), config)
    return corrupted if by is None else pad_targets(corrupted, config, by)


# What training plans can ask for: ``fn(samples, config, by) -> samples``; users may register more.
OBJECTIVES = Registry("objective")
OBJECTIVES.register("mlm")(mlm)
OBJECTIVES.register("electra")(electra)
OBJECTIVES.register("span_corruption")(span_corruption)


def build(name: str, samples: DataFrame, config: MaskConfig | SpanConfig, by: list[str] | None = None) -> DataFrame:
    """Samples of the objective of that name."""
    return OBJECTIVES.build(name, samples, config, by)

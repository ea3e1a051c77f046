"""Array column expressions over token ids and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import IGNORE_LABEL, MAX_TOKEN_ID, TokenIdentity


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def special_mask(ids: Column, identity: TokenIdentity) -> Column:
    return F.transform(ids, lambda x: x.isin(*identity.special_ids))


def attention_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def label_mask(labels: Column) -> Column:
    return F.transform(labels, lambda x: (x != IGNORE_LABEL).cast("int"))


def pad_to(ids: Column, length: Column, value: int) -> Column:
    """Right-pads to ``length``; a longer sequence stays whole."""
    missing = F.greatest(length.cast("int") - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(value), missing))


def valid_labels(labels: Column) -> Column:
    """Labels that count for the loss."""
    return F.filter(labels, lambda x: x != IGNORE_LABEL)


def label_count(labels: Column) -> Column:
    return F.size(valid_labels(labels))


def bad_ids(ids: Column) -> Column:
    """Ids that a shard file can't hold."""
    return F.filter(ids, lambda x: (x < 0) | (x > MAX_TOKEN_ID))


def guard_ids(ids: Column) -> Column:
    """``ids`` itself; the job fails if one doesn't fit in 16 bits."""
    problem = F.concat(F.lit("Tokens must fit in uint16, found "), F.get(bad_ids(ids), F.lit(0)).cast("string"))
    return F.when(F.forall(ids, lambda x: (x >= 0) & (x <= MAX_TOKEN_ID)), ids).otherwise(
        F.raise_error(problem).cast("array<int>")
    )

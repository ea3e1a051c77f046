"""Random numbers that depend on their keys alone, never on partitioning or retries."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let

DRAW_RANGE = 2**32

# First key of every draw, so that uses of the same seed stay independent.
PERMUTE, MASK, SPAN_LENGTH, SPAN_GAP, FEISTEL = 1, 2, 3, 4, 5

HASHES = ("xxhash64", "md5")


def _bigint(key: Column | int) -> Column:
    return (F.lit(key) if isinstance(key, int) else key).cast("bigint")


def _md5(keys: tuple[Column | int, ...]) -> Column:
    return F.md5(F.concat_ws(":", *[_bigint(k).cast("string") for k in keys]))


def _hash60(hash_fn: str, keys: tuple[Column | int, ...]) -> Column:
    if hash_fn == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*[_bigint(k) for k in keys]), 4)
    if hash_fn == "md5":
        return F.conv(F.substring(_md5(keys), 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"Unknown hash_fn {hash_fn!r}. Available: {list(HASHES)}")


def sort_key(hash_fn: str, *keys: Column | int) -> Column:
    """60 random bits."""
    return _hash60(hash_fn, keys)


def draw(hash_fn: str, *keys: Column | int) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.shiftrightunsigned(_hash60(hash_fn, keys), 28)


def chosen(probability: float, hash_fn: str, *keys: Column | int) -> Column:
    """Bernoulli draw; integers are compared, so every engine agrees.

    A draw by md5 is the number of its first 8 hex digits: these are compared as they
    are, as their conversion takes longer than the hash.
    """
    limit = math.floor(probability * DRAW_RANGE)
    if hash_fn == "md5" and 0 <= limit < DRAW_RANGE:
        return _md5(keys) < F.lit(f"{limit:08x}")
    return draw(hash_fn, *keys) < F.lit(limit).cast("bigint")


def chosen_of(
    body: Callable[[Callable[[Column], Column]], Column], probability: float, hash_fn: str, *keys: Column | int
) -> Column:
    """``body`` with the choice by a last key for these first ones, whose text is made once for all elements of an array."""
    limit = math.floor(probability * DRAW_RANGE)
    if hash_fn != "md5" or not 0 <= limit < DRAW_RANGE:
        return body(lambda last: chosen(probability, hash_fn, *keys, last))
    first = F.concat_ws(":", *[_bigint(k).cast("string") for k in keys], F.lit(""))
    return let(first, lambda text: body(lambda last: F.md5(F.concat(text, last.cast("string"))) < F.lit(f"{limit:08x}")))

"""Running sums over the whole table without a one-task sort.

Keys are BIGINT and unique (per group), so a bucket of 2^bits neighbouring
keys holds at most 2^bits rows, however the keys are spread. Buckets are
summed the same way, level by level, until one level is small. Null keys, which
would leave a hole in the sums, are an error, and so are repeated ones where a
sum over rows depends on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 8
LEVEL_BITS = 16


def _before(value: Column, by: list[str], order: str) -> Column:
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0).cast("bigint"))


def bucket_of(key: str, bits: int) -> Column:
    """The key's bucket; a null key is an error."""
    missing = F.raise_error(F.lit(f"Null in the order key {key}")).cast("bigint")
    return F.when(F.col(key).isNotNull(), F.shiftright(key, bits)).otherwise(missing)


def before_in_bucket(value: Column, by: list[str], key: str) -> Column:
    """Sum over the smaller keys of the row's group; a repeated key is an error."""
    repeated = F.lag(key).over(Window.partitionBy(*by).orderBy(key)) == F.col(key)
    message = F.format_string(f"The order key {key} is repeated: %s", F.col(key).cast("string"))
    return F.when(repeated, F.raise_error(message).cast("bigint")).otherwise(_before(value, by, key))


def _accumulate(sums: DataFrame, by: list[str], buckets: int, values: list[str]) -> DataFrame:
    """Adds ``before_<v>`` for every v, the sum over all smaller buckets of the group."""
    if buckets <= 1 << LEVEL_BITS:
        return sums.select("*", *[_before(F.col(v), by, "bucket").alias(f"before_{v}") for v in values])
    sums = sums.withColumn("block", F.shiftright("bucket", LEVEL_BITS))
    blocks = sums.groupBy(*by, F.col("block").alias("bucket")).agg(*[F.sum(v).alias(v) for v in values])
    blocks = _accumulate(blocks, by, (buckets >> LEVEL_BITS) + 2, values).select(
        *by, F.col("bucket").alias("block"), *[F.col(f"before_{v}").alias(f"block_{v}") for v in values]
    )
    inner = sums.select("*", *[_before(F.col(v), [*by, "block"], "bucket").alias(f"in_{v}") for v in values])
    joined = inner.join(blocks, [*by, "block"])
    return joined.select(
        *by,
        "bucket",
        *values,
        *[(F.col(f"in_{v}") + F.col(f"block_{v}")).alias(f"before_{v}") for v in values],
    )


def bucket_count(df: DataFrame, key: str, bits: int) -> int:
    """Number of buckets between the smallest and the largest key."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    return 0 if low is None else (high >> bits) - (low >> bits) + 1


def bucket_sums(
    df: DataFrame, key: str, values: dict[str, Column], by: list[str] | None = None,
    bits: int = BUCKET_BITS, buckets: int | None = None,
) -> DataFrame:
    """One row per bucket: ``by``, ``bucket``, each value's sum, and ``before_<value>``."""
    by = by or []
    if buckets is None:
        buckets = bucket_count(df, key, bits)
    sums = df.groupBy(*by, bucket_of(key, bits).alias("bucket")).agg(
        *[F.sum(c).alias(name) for name, c in values.items()]
    )
    return _accumulate(sums, by, buckets, list(values))


def running_sums(
    df: DataFrame, key: str, values: dict[str, Column], by: list[str] | None = None,
    bits: int = BUCKET_BITS, sums_from: DataFrame | None = None, buckets: int | None = None,
    partitions: int | None = None, unique: bool = False,
) -> DataFrame:
    """Adds per value v: ``before_<v>`` (sum over all smaller keys), ``low_<v>`` and ``high_<v>``
    (the same at both ends of the row's bucket), next to ``bucket``.

    Rows of one bucket end up in one partition. ``sums_from`` may name a
    narrower table with the same keys to take the bucket sums from,
    ``partitions`` the width of the shuffle by bucket. ``unique`` refuses
    repeated keys.
    """
    by = by or []
    source = df if sums_from is None else sums_from
    bases = bucket_sums(source, key, values, by, bits, buckets).select(
        *by,
        "bucket",
        *[F.col(f"before_{v}").alias(f"low_{v}") for v in values],
        *[(F.col(f"before_{v}") + F.col(v)).alias(f"high_{v}") for v in values],
    )
    rows = df.withColumn("bucket", bucket_of(key, bits))
    if partitions:
        rows = rows.repartition(partitions, *by, "bucket")
    inner = before_in_bucket if unique else _before
    rows = rows.select("*", *[inner(c, [*by, "bucket"], key).alias(f"in_{v}") for v, c in values.items()])
    joined = rows.join(bases, [*by, "bucket"])
    for v in values:
        joined = joined.withColumn(f"before_{v}", F.col(f"in_{v}") + F.col(f"low_{v}"))
    return joined.drop(*[f"in_{v}" for v in values])

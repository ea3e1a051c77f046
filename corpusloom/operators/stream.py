"""Places documents end to end in one global token stream and cuts it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from corpusloom.config import SHARD_PREFIX
from corpusloom.functions.scalars import idiv, shard_name, split_label
from corpusloom.operators.prefix import (
    BUCKET_BITS,
    before_in_bucket,
    bucket_sums,
    running_sums,
)
from corpusloom.session import materialize

def stream_offsets(
    doc_tokens: DataFrame, key: str = "doc_id", bits: int = BUCKET_BITS, partitions: int | None = None
) -> DataFrame:
    """pieces(key, tokens, start, end, bucket, low, high). Null or repeated keys are an error.

    [start, end) is the document's place in the stream, [low, high) that of its
    bucket of neighbouring documents, which share a partition.
    """
    placed = running_sums(
        doc_tokens, key, {"n": F.col("n").cast("bigint")}, bits=bits, sums_from=doc_tokens.select(key, "n"),
        partitions=partitions, unique=True,
    )
    return placed.select(
        key,
        "tokens",
        F.col("before_n").alias("start"),
        (F.col("before_n") + F.col("n")).alias("end"),
        "bucket",
        F.col("low_n").alias("low"),
        F.col("high_n").alias("high"),
    )


def _cells(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _cut(
    cells: Column, start: Column, end: Column, tokens: Column, size: int, offset: int = 0
) -> Column:
    """One struct (cell, at, part) per cell of ``size`` positions that [start, end) touches.

    Cell 0 begins at ``offset``. Slices are made inside the row, so a long
    document is copied once, not once per cell.
    """

    def part(cell: Column) -> Column:
        begin = F.greatest(start, cell * size + offset)
        stop = F.least(end, cell * size + (offset + size))
        sliced = F.slice(tokens, (begin - start + 1).cast("int"), (stop - begin).cast("int"))
        return F.struct(cell.alias("cell"), begin.alias("at"), sliced.alias("part"))

    return F.transform(cells, part)


def _after(position: Column, offset: int) -> Column:
    """Distance from the offset, 0 before it."""
    return F.greatest(position - offset, F.lit(0).cast("bigint")) if offset else position


def _joined(parts: Column) -> Column:
    return F.flatten(F.sort_array(parts)["part"])


def _assemble(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(_joined(F.collect_list(F.struct("at", "part"))).alias("input_ids"))


def windows(pieces: DataFrame, length: int, offset: int = 0, epoch: int = 0) -> DataFrame:
    """windows(epoch, seq_idx, input_ids): all windows of ``length`` tokens, across documents.

    A window inside one bucket is put together where the bucket already lies;
    only the windows on a bucket's two edges go through another shuffle.
    Whatever doesn't fill a window, at the end of the stream, is dropped.
    """
    seen = pieces.where(F.col("end") > offset) if offset else pieces
    start, end, tokens = F.col("start"), F.col("end"), F.col("tokens")
    low, high = _after(F.col("low"), offset), _after(F.col("high"), offset)
    first, last = idiv(_after(start, offset), length), idiv(end - (offset + 1), length)
    first_inside, last_inside = idiv(low + (length - 1), length), idiv(high, length) - 1

    inside = _cells(F.greatest(first, first_inside), F.least(last, last_inside))
    inside = seen.select("bucket", F.inline(_cut(inside, start, end, tokens, length, offset)))
    inside = _assemble(inside, ["bucket", "cell"]).select("cell", "input_ids")

    on_edge = seen.where((first < first_inside) | (last > last_inside))
    edges = F.filter(
        F.array_distinct(F.array(idiv(low, length), idiv(high, length))),
        lambda c: ((c < first_inside) | (c > last_inside)) & c.between(first, last),
    )
    edges = on_edge.select(F.inline(_cut(edges, start, end, tokens, length, offset)))
    edges = _assemble(edges, ["cell"])

    whole = inside.unionByName(edges).where(F.size("input_ids") == length)
    return whole.select(F.lit(epoch).alias("epoch"), F.col("cell").alias("seq_idx"), "input_ids")


def windows_from_chunks(chunks: DataFrame, length: int, offset: int = 0, epoch: int = 0) -> DataFrame:
    """As ``windows``, for chunks(start, tokens) that are long compared to a window."""
    seen = chunks.select("start", (F.col("start") + F.size("tokens")).alias("end"), "tokens")
    seen = seen.where(F.col("end") > offset)
    start, end, tokens = F.col("start"), F.col("end"), F.col("tokens")
    cells = _cells(idiv(_after(start, offset), length), idiv(end - (offset + 1), length))
    parts = seen.select(F.inline(_cut(cells, start, end, tokens, length, offset)))
    complete = parts.where(F.size("part") == length).select("cell", F.col("part").alias("input_ids"))
    crossing = _assemble(parts.where(F.size("part") < length), ["cell"]).where(F.size("input_ids") == length)
    whole = complete.unionByName(crossing)
    return whole.select(F.lit(epoch).alias("epoch"), F.col("cell").alias("seq_idx"), "input_ids")


def lookup_window(
    doc_tokens: DataFrame, seq_idx: int, length: int, total: int, offset: int = 0, key: str = "doc_id"
) -> DataFrame:
    """One window by index, without moving tokens.

    Places come from the lengths alone; the at most ``length`` documents that the
    window touches are neighbours, so their range of keys is pushed into the scan.
    """
    count = max(total - offset, 0) // length
    if not 0 <= seq_idx < count:
        raise IndexError(f"Index {seq_idx} out of range [0, {count})")
    begin = offset + seq_idx * length
    places = running_sums(doc_tokens.select(key, "n"), key, {"n": F.col("n").cast("bigint")})
    overlaps = (F.col("before_n") < begin + length) & (F.col("before_n") + F.col("n") > begin)
    touched = places.where(overlaps).select(key, F.col("before_n").alias("start")).collect()
    near = doc_tokens.where(F.col(key).between(min(r[key] for r in touched), max(r[key] for r in touched)))
    starts = doc_tokens.sparkSession.createDataFrame(touched, f"{key} bigint, start bigint")
    pieces = near.join(F.broadcast(starts), key).select("start", "tokens")
    return windows_from_chunks(pieces, length, offset).where(F.col("seq_idx") == seq_idx)


def _shard_columns(cell: Column, at: Column, part: Column, size: int, total: int, val_shards: int, prefix: str):
    index = cell.cast("int")
    split = split_label(index, val_shards)
    return [
        split.alias("split"),
        index.alias("shard_index"),
        shard_name(split, index, prefix).alias("name"),
        F.least(F.lit(size).cast("bigint"), F.lit(total) - cell * size).alias("shard_tokens"),
        (at - cell * size).alias("start"),
        part.alias("tokens"),
    ]


def shard_pieces(
    pieces: DataFrame, shard_size: int, total: int, val_shards: int = 0, prefix: str = SHARD_PREFIX
) -> DataFrame:
    """shard_pieces(split, shard_index, name, shard_tokens, start, tokens).

    ``start`` counts from the shard's first token. Every shard holds exactly
    ``shard_size`` tokens except the last.
    """
    if shard_size < 1:
        raise ValueError(f"shard_size must be >= 1, got {shard_size}")
    start, end = F.col("start"), F.col("end")
    cells = _cells(idiv(start, shard_size), idiv(end - 1, shard_size))
    parts = pieces.select(F.inline(_cut(cells, start, end, F.col("tokens"), shard_size)))
    columns = _shard_columns(F.col("cell"), F.col("at"), F.col("part"), shard_size, total, val_shards, prefix)
    return parts.select(*columns)


def _borders(narrow: DataFrame, key: str, shard_size: int) -> DataFrame:
    """(cell, first, first_start, last): the first and last document of every shard, and where the first begins.

    From the lengths alone: one row per shard, a few hundred thousand for the largest corpora.
    """
    places = running_sums(narrow, key, {"n": F.col("n").cast("bigint")}, unique=True)
    start = F.col("before_n")
    cells = _cells(idiv(start, shard_size), idiv(start + F.col("n") - 1, shard_size))
    touched = places.where("n > 0").select(key, start.alias("start"), F.explode(cells).alias("cell"))
    return touched.groupBy("cell").agg(
        F.min(key).alias("first"), F.min("start").alias("first_start"), F.max(key).alias("last")
    )


def _cells_of(borders):
    """The shards that a document touches: neighbours in the sorted table of borders."""

    @F.arrow_udf(ArrayType(LongType()))
    def find(keys: pa.Array) -> pa.Array:
        cells, first, last = borders.value
        at = keys.to_numpy()
        low, high = np.searchsorted(last, at, side="left"), np.searchsorted(first, at, side="right")
        counts = np.maximum(high - low, 0)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - low, counts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells[places], pa.int64()))

    return find


def shards_in_one_shuffle(
    doc_tokens: DataFrame, shard_size: int, total: int, val_shards: int = 0, prefix: str = SHARD_PREFIX,
    key: str = "doc_id", partitions: int | None = None,
) -> DataFrame:
    """As ``shard_pieces``, already with each shard in one partition and in order.

    The shards' borders follow from the lengths alone; they are sent to all tasks
    (a row per shard), so each document goes straight to the shard it lies in,
    or to all it touches, and is placed there. Tokens move once, whatever the
    keys, the documents' lengths and the size of shards.
    """
    if shard_size < 1:
        raise ValueError(f"shard_size must be >= 1, got {shard_size}")
    spark = doc_tokens.sparkSession
    borders = materialize(_borders(doc_tokens.select(key, "n"), key, shard_size), "shard-borders")
    table = borders.orderBy("cell").toArrow()
    cells, first, last = (table[c].to_numpy() for c in ("cell", "first", "last"))
    shipped = spark.sparkContext.broadcast((cells, first, last))
    length = F.col("n").cast("bigint")
    rows = doc_tokens.where("n > 0").select(key, "tokens", "n")
    rows = rows.withColumn("cell", F.explode(_cells_of(shipped)(F.col(key))))
    width = [partitions] if partitions else []
    rows = rows.repartition(*width, "cell")
    before = before_in_bucket(length, ["cell"], key)
    starts = borders.select("cell", "first_start")
    placed = rows.withColumn("before", before).join(F.broadcast(starts), "cell")
    placed = placed.withColumn("start", F.col("first_start") + F.col("before"))
    start, cell = F.col("start"), F.col("cell")
    begin, stop = F.greatest(start, cell * shard_size), F.least(start + length, (cell + 1) * shard_size)
    part = F.slice("tokens", (begin - start + 1).cast("int"), (stop - begin).cast("int"))
    return placed.select(*_shard_columns(cell, begin, part, shard_size, total, val_shards, prefix))


def first_documents(documents: DataFrame, max_docs: int | None, key: str = "doc_id") -> DataFrame:
    """The first ``max_docs`` documents in stream order; none or 0 keeps all.

    Counts per range of keys give the range that holds the last document, and a
    look at that range its key. So the cap is a filter on the key, which goes
    into the scan, and no text moves.
    """
    if not max_docs:
        return documents
    keys = documents.select(key).where(F.col(key).isNotNull())
    counted = bucket_sums(keys, key, {"rows": F.lit(1).cast("bigint")})
    border = counted.where((F.col("before_rows") < max_docs) & (F.col("before_rows") + F.col("rows") >= max_docs)).first()
    if border is None:
        return documents
    low = border["bucket"] << BUCKET_BITS
    near = keys.where(F.col(key).between(low, low + (1 << BUCKET_BITS) - 1))
    cut = near.orderBy(key).limit(max_docs - border["before_rows"]).agg(F.max(key)).first()[0]
    return documents.where(F.col(key) <= cut)

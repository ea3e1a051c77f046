"""Token vectors and their means per sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Token vectors beyond this size are joined by shuffle.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024

SALTS = 32

# Ids that a sketch follows, and the share of all rows from which one is frequent.
SKETCHED_IDS = 1024
HOT_SHARE = 1 / 256

# Bounds a task's memory: positions whose vectors are held at the same time.
POSITIONS_AT_ONCE = 1 << 16

# Sequences that share one copy of each vector where vectors are joined.
SEQUENCES_PER_BLOCK = 1 << 11


def _measured(vectors: DataFrame) -> tuple[int, int, int]:
    """(bytes as doubles, dimensions, largest id) of a vector table; refuses repeated ids and uneven lengths."""
    row = vectors.agg(
        F.count("*"),
        F.count_distinct("token_id"),
        F.coalesce(F.min(F.size("vec")), F.lit(0)),
        F.coalesce(F.max(F.size("vec")), F.lit(0)),
        F.coalesce(F.max("token_id"), F.lit(-1)),
        F.coalesce(F.min("token_id"), F.lit(0)),
    ).first()
    count, distinct, shortest, dims, top, low = row
    if count != distinct or low < 0:
        raise ValueError("Token vectors need one row per id, and ids that aren't negative")
    if shortest != dims:
        raise ValueError("All vectors must have the same length")
    return (top + 1) * (dims * 8 + 16), dims, top


def frequent_ids(at: DataFrame, share: float = HOT_SHARE) -> list[int]:
    """Ids that may hold ``share`` of all rows or more, fewer than 2 / ``share`` of them.

    Counted by mergeable sketches of bounded size. A sketch may name an id that is
    less frequent, which costs a row of the broadcast, and misses none above the
    share by more than its error.
    """
    sketch = F.expr(f"approx_top_k(token_id, {int(2 / share)}, {max(SKETCHED_IDS, int(8 / share))})")
    rows, top = at.where("token_id IS NOT NULL").agg(F.count("*"), sketch).first()
    return sorted(x["item"] for x in top or [] if x["count"] >= share * rows)


def _looked_up(at: DataFrame, vectors: DataFrame, key: str, size: int, max_broadcast_bytes: int) -> DataFrame:
    """Adds ``vec`` to (key, pos, token_id); an id without a vector is an error."""
    known = _marked(vectors)
    if size <= max_broadcast_bytes:
        joined = at.join(F.broadcast(known), "token_id", "left")
    else:
        # Frequent ids get their vectors by broadcast and the rest are joined, so no vector is copied to salts.
        hot = frequent_ids(at)
        usual, often = (at.where(F.col("token_id").isin(hot) == x) if hot else at for x in (False, True))
        joined = usual.join(known.hint("shuffle_merge"), "token_id", "left")
        if hot:
            few = known.where(F.col("token_id").isin(hot))
            joined = joined.unionByName(often.join(F.broadcast(few), "token_id", "left"))
    return _all_known(joined).select(key, "pos", "token_id", "vec")


def _marked(vectors: DataFrame) -> DataFrame:
    return vectors.select("token_id", "vec", F.lit(True).alias("known"))


def _all_known(joined: DataFrame) -> DataFrame:
    # A filter of its own, so that reading the vector stays a plain column.
    unknown = F.raise_error(F.format_string("No vector for token %s", F.col("token_id").cast("string")))
    return joined.where(F.coalesce("known", unknown.cast("boolean")))


def lookup_vectors(
    samples: DataFrame, vectors: DataFrame, key: str = "seq_idx", ids: str = "input_ids",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(key, pos, token_id, vec) for every position; vectors are (token_id, vec), one row per id.

    An id without a vector is an error. The vectors are measured before they
    are broadcast. Larger ones are joined by id, but for the frequent ids, as
    one token can be a third of all positions.
    """
    at = samples.select(key, F.posexplode(ids).alias("pos", "token_id"))
    return _looked_up(at, vectors, key, _measured(vectors)[0], max_broadcast_bytes)


def _summed(group: np.ndarray, groups: int, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group, 0 to ``groups`` - 1, that occurs."""
    order = np.argsort(group, kind="stable")
    ranked = group[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sums = np.zeros((groups, values.shape[1]))
    sums[ranked[starts]] = np.add.reduceat(values[order], starts)
    return sums


def _vectors_of(column: pa.Array, rows: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("All vectors must have the same length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _batch(names: list[str], keys: pa.Array, sums: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([keys, lists, *map(pa.array, more)], names=names)


def _partial_sums(key: str):
    """Sums vectors per group within each Arrow batch, so that far less is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = _vectors_of(batch.column("vec"), batch.num_rows)
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            encoded = batch.column(key).dictionary_encode(null_encoding="encode")
            group = encoded.indices.to_numpy()
            sums = _summed(group, len(encoded.dictionary), values * weights[:, None])
            total = np.bincount(group, weights=weights, minlength=len(sums))
            yield _batch([key, "sums", "total"], encoded.dictionary, sums, total)

    return add


def _merged_means(key: str):
    """Means of partial sums that come sorted by key; a key may go on in the next batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_sum, open_total = None, None, 0.0

        def mean(sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
            return sums / np.maximum(totals, 1e-9)[:, None]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            encoded = batch.column(key).dictionary_encode(null_encoding="encode")
            group, keys = encoded.indices.to_numpy(), encoded.dictionary
            sums = _summed(group, len(keys), _vectors_of(batch.column("sums"), batch.num_rows))
            totals = np.bincount(group, weights=batch.column("total").to_numpy(), minlength=len(keys))
            if open_sum is not None:
                if len(open_sum) != sums.shape[1]:
                    raise ValueError("All vectors must have the same length")
                if keys[0].as_py() == open_key:
                    sums[0] += open_sum
                    totals[0] += open_total
                else:
                    before = pa.array([open_key], keys.type)
                    yield _batch([key, "pooled"], before, mean(open_sum[None], np.array([open_total])))
            open_key, open_sum, open_total = keys[-1].as_py(), sums[-1], totals[-1]
            kind = keys.type
            if len(keys) > 1:
                yield _batch([key, "pooled"], keys[:-1], mean(sums[:-1], totals[:-1]))
        if open_sum is not None:
            yield _batch([key, "pooled"], pa.array([open_key], kind), mean(open_sum[None], np.array([open_total])))

    return merge


def masked_mean_pool(states: DataFrame, key: str, vec: str = "vec", mask: str | None = "mask") -> DataFrame:
    """(key, pooled): sum of vec x mask over sum of mask; an all-zero mask gives zeros.

    Rows are (key, vec, mask), one per position; without ``mask`` it is the
    plain mean. Only partial sums are shuffled, as arrays, and merged in the
    order of their keys: a frequent key is a few rows per task, a wide vector no
    rows more.
    """
    weight = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    rows = states.select(key, F.col(vec).alias("vec"), weight.alias("weight"))
    key_type = states.schema[key].dataType.simpleString()
    partial = rows.mapInArrow(_partial_sums(key), f"{key} {key_type}, sums array<double>, total double")
    together = partial.repartition(key).sortWithinPartitions(key)
    return together.mapInArrow(_merged_means(key), f"{key} {key_type}, pooled array<double>")


def mean_pool(states: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    return masked_mean_pool(states, key, vec, mask=None)


def _tokens_of_blocks(key: str):
    """(block, token_id, keys, counts): which sequences have a token how often, a row per token and block.

    Rows are (key, ids, block), sorted by block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            borders = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for first, stop in zip(borders, borders[1:]):
                for at in range(first, stop, SEQUENCES_PER_BLOCK):
                    yield counted(batch.slice(at, min(SEQUENCES_PER_BLOCK, stop - at)), blocks[at])

    def counted(rows: pa.RecordBatch, block: int) -> pa.RecordBatch:
        lists, n = rows.column("ids"), rows.num_rows
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        codes, counts = np.unique(lists.flatten().to_numpy().astype(np.int64) * n + row, return_counts=True)
        tokens = codes // n
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, int)
        ends = pa.array(np.r_[starts, len(tokens)], pa.int32())
        keys = rows.column(key).take(pa.array(codes % n))
        columns = [
            pa.array(np.full(len(starts), block)), pa.array(tokens[starts], pa.int32()),
            pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "token_id", "keys", "counts"])

    return count


def _sums_of_blocks(key: str):
    """Partial sums per key from (keys, counts, vec), a block of entries at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = _vectors_of(batch.column("vec"), batch.num_rows)
            lists = batch.column("keys")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            weights = batch.column("counts").flatten().to_numpy().astype(np.float64)
            encoded = lists.flatten().dictionary_encode(null_encoding="encode")
            group = encoded.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            sums = np.zeros((len(encoded.dictionary), values.shape[1]))
            for at in range(0, len(order), POSITIONS_AT_ONCE):
                some = order[at : at + POSITIONS_AT_ONCE]
                ranked = group[some]
                starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                sums[ranked[starts]] += np.add.reduceat(values[row[some]] * weights[some, None], starts)
            yield _batch([key, "sums", "total"], encoded.dictionary, sums, np.bincount(group, weights, len(sums)))

    return add


def _mean_by_blocks(samples: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, pooled): means of the vectors of (key, ids), looked up once per token and block of sequences.

    What is shuffled is a vector per token of a block, and the sums of a block's
    sequences: a vector per position would be as many as the corpus has tokens.
    A token has few rows per block, so none is frequent.
    """
    key_type = samples.schema[key].dataType.simpleString()
    blocks = max(-(-samples.count() // SEQUENCES_PER_BLOCK), 1)
    placed = samples.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint")))
    placed = placed.repartition("block").sortWithinPartitions("block")
    kind = f"block bigint, token_id int, keys array<{key_type}>, counts array<bigint>"
    counted = placed.mapInArrow(_tokens_of_blocks(key), kind)
    joined = _all_known(counted.join(_marked(vectors).hint("shuffle_merge"), "token_id", "left"))
    gathered = joined.select("block", "keys", "counts", "vec").repartition("block").sortWithinPartitions("block")
    partial = gathered.mapInArrow(_sums_of_blocks(key), f"{key} {key_type}, sums array<double>, total double")
    together = partial.repartition(key).sortWithinPartitions(key)
    return together.mapInArrow(_merged_means(key), f"{key} {key_type}, pooled array<double>")


def _gather_and_average(shipped, key: str, pad_id: int):
    """Averages the vectors of each sequence's ids, a block of positions at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shipped.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            kept = ids != pad_id
            ids, row = ids[kept], row[kept]
            there = (ids >= 0) & (ids < len(known))
            there[there] = known[ids[there]]
            if not there.all():
                raise ValueError(f"No vector for token {ids[~there][0]}")
            sums = np.zeros((batch.num_rows, table.shape[1]))
            for at in range(0, len(ids), POSITIONS_AT_ONCE):
                rows = row[at : at + POSITIONS_AT_ONCE]
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                sums[rows[starts]] += np.add.reduceat(table[ids[at : at + POSITIONS_AT_ONCE]], starts)
            weights = np.maximum(np.bincount(row, minlength=batch.num_rows), 1e-9)
            yield _batch([key, "pooled"], batch.column(0), sums / weights[:, None])

    return run


def embed_sequences(
    samples: DataFrame, vectors: DataFrame, pad_id: int, key: str = "seq_idx", ids: str = "input_ids",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Default encoder: token vectors, looked up and averaged over the positions that aren't padding.

    An id without a vector is an error; a sequence of nothing, or of nothing but
    padding, gives zeros. Vectors that fit, as measured, are sent to the workers,
    and every sequence is averaged where it lies. Larger ones are joined with the
    tokens of blocks of sequences, with the same results.
    """
    size, dims, top = _measured(vectors)
    if size > max_broadcast_bytes:
        kept = F.filter(ids, lambda x: x != pad_id)
        pooled = _mean_by_blocks(samples.select(key, kept.alias("ids")), vectors, key)
        zeros = F.array_repeat(F.lit(0.0), dims)
        found = samples.select(key).join(pooled, key, "left")
        return found.select(key, F.coalesce("pooled", zeros).alias("pooled"))
    rows = vectors.select("token_id", "vec").toArrow()
    flat = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    token_ids = rows["token_id"].to_numpy()
    table, known = np.zeros((top + 1, dims)), np.zeros(top + 1, bool)
    table[token_ids], known[token_ids] = flat.reshape(len(token_ids), dims), True
    shipped = samples.sparkSession.sparkContext.broadcast((table, known))
    key_type = samples.schema[key].dataType.simpleString()
    return samples.select(key, ids).mapInArrow(
        _gather_and_average(shipped, key, pad_id), f"{key} {key_type}, pooled array<double>"
    )


def encode_with(
    samples: DataFrame, encoder: Callable[[], Callable[[list, list], np.ndarray]],
    key: str = "seq_idx", ids: str = "input_ids", mask: str = "attention_mask",
) -> DataFrame:
    """(key, pooled) from a user's encoder.

    ``encoder()`` is called once per task and returns ``fn(ids, masks)``, which
    gives one vector per sequence of the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = encoder()
        for batch in batches:
            if batch.num_rows:
                found = fn(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                pooled = pa.array([np.asarray(v, np.float32) for v in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pooled], names=[key, "pooled"])

    source = samples.select(key, ids, mask)
    key_type = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {key_type}, pooled array<float>")

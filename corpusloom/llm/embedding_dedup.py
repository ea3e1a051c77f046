"""Near duplicates among vectors: all pairs by cosine, in PCA-ordered tiles.

Vectors are scaled to length 1 and turned onto the principal axes of all of them,
so that their leading numbers carry most of a product. Two vectors' product is
the part over the leading axes plus a rest, which is at most the product of the
two suffixes' lengths (Cauchy and Schwarz). A tile is compared with a tile on the
leading axes first; that bound is one matrix product, with the suffix length as
one more axis. Pairs whose bound misses the threshold end there. The others add
the next axes, are bounded again, and what is left is computed in full, in double
precision, from the vectors as given. The axes change the work, never a link.

Vectors lie in tiles in order of their leading coordinates, and a tile knows the
box that they fill and its largest suffix; a pair of tiles, or of bands of tiles,
whose boxes can't reach the threshold isn't compared at all. Every band meets
every other band that its box leaves: copies of a band are shuffled, one per
meeting, and a task holds two bands of bounded bytes. Equal vectors are one
vector with a weight, so copies don't meet.

A meeting yields one row per linked vector: how many vectors it links there, and
the smallest vector that it reaches there. So what is shuffled on grows with the
vectors, not with the links. Components are found by alternating stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers link with nothing, nor do they with each other. Vectors of different
length aren't linked. Null ids don't count for a component's smallest id; it is
null if all are. Repeated rows are vectors of their own, linked with each other.
An empty table gives an empty result. Only the columns asked for are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import wide
from corpusloom.llm.components import components
from corpusloom.llm.simhash import spanning
from corpusloom.session import materialize, ship_package

THRESHOLD = 0.9
# Bytes of a band, of which a task holds two, and of a tile, one row.
BAND_BYTES = 16 << 20
TILE_BYTES = 1 << 20
# A vector's key is its tile and its place there, of so many bits.
TILE_BITS = 12
ROWS_PER_TASK = 1 << 20
# Axes that are turned; numbers beyond them stay as they are.
AXES = 1024
# Leading axes that order the vectors and that a box has.
ORDER_AXES = 4
BOX_AXES = 8
# Shares of the squared lengths after which a pair is bounded.
SHARES = (0.4, 0.6, 0.8)
# Single precision on lengths of 1: what a bound may be off by.
MARGIN = 1e-4
_ROWS = 1024
_PAIRS = 1 << 20
_TILE = (
    "band int, tile bigint, dim int, n int, low array<double>, high array<double>, tail double,"
    " vectors binary, digests array<binary>, weights array<bigint>"
)


def _rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None if it is null, empty, zero or holds a null or non-finite number."""
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten()
    if len(column) and not column.null_count and not flat.null_count and lengths[0] and (lengths == lengths[0]).all():
        x = flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
        usable = np.isfinite(x).all(axis=1) & x.any(axis=1)
        return [row if ok else None for row, ok in zip(x, usable)]
    found = []
    for value in column:
        if not value.is_valid or value.values is None or len(value.values) == 0 or value.values.null_count:
            found.append(None)
            continue
        x = value.values.to_numpy(zero_copy_only=False)
        found.append(x if np.isfinite(x).all() and x.any() else None)
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _rows_of(batch.column("vector"))
        # Adding zero turns -0.0 into 0.0.
        made = [None if x is None else hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary()), batch.column("vector")], ["id", "digest", "vector"])


def _unit(rows: list[np.ndarray], dim: int) -> np.ndarray:
    """The vectors at length 1, with zeros up to ``dim`` numbers."""
    if all(len(row) == dim for row in rows):
        x = np.array(rows)
    else:
        x = np.zeros((len(rows), dim))
        for i, row in enumerate(rows):
            x[i, : len(row)] = row
    # Scaled first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Axes:
    """The principal axes of the first ``AXES`` numbers, and where a pair's product is bounded."""

    turn: np.ndarray
    spread: np.ndarray
    edges: tuple[int, ...]

    def turned(self, unit: np.ndarray) -> np.ndarray:
        m = len(self.turn)
        if unit.shape[1] < m:
            return np.pad(unit, ((0, 0), (0, m - unit.shape[1]))) @ self.turn
        return np.concatenate((unit[:, :m] @ self.turn, unit[:, m:]), axis=1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((0, 0))
    for batch in batches:
        rows = _rows_of(batch.column("vector"))
        for at in range(0, len(rows), _ROWS):
            part = rows[at : at + _ROWS]
            x = _unit(part, max(map(len, part)))[:, :AXES]
            if x.shape[1] > len(total):
                total = np.pad(total, (0, x.shape[1] - len(total)))
            total[: x.shape[1], : x.shape[1]] += x.T @ x
    if len(total):
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], ["i", "products"])


def fit_axes(vectors: DataFrame) -> Axes:
    """Principal axes of all ``(vector)``; sums of products are at most AXES x AXES numbers."""
    sums = vectors.select("vector").mapInArrow(_moments, "i int, products array<double>")
    sums = sums.select("i", F.posexplode("products").alias("j", "p")).groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    if not len(sums):
        return Axes(np.zeros((0, 0)), np.zeros(0), ())
    dim = int(sums["i"].max()) + 1
    matrix = np.zeros((dim, dim))
    matrix[sums["i"], sums["j"]] = sums["p"]
    values, turn = np.linalg.eigh(matrix)
    values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    edges = tuple(sorted({min(int(np.searchsorted(share, s)) + 1, dim) for s in SHARES}))
    return Axes(np.ascontiguousarray(turn), np.sqrt(values / max(values.sum(), 1e-300)), edges)


def _code(turned: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Place on a curve through the leading axes: three bits an axis, interleaved."""
    lead = min(ORDER_AXES, turned.shape[1], len(spread))
    step = np.clip(((turned[:, :lead] / np.maximum(2 * spread[:lead], 1e-9)) + 1) * 4, 0, 7).astype(np.int64)
    code = np.zeros(len(turned), np.int64)
    for bit in (2, 1, 0):
        for axis in range(lead):
            code = code * 2 + ((step[:, axis] >> bit) & 1)
    return code


def _ordered(axes: Axes):
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows_of(batch.column("vector"))
            codes, dims = np.zeros(len(rows), np.int64), np.array([len(x) for x in rows], np.int32)
            for at in range(0, len(rows), _ROWS):
                part = rows[at : at + _ROWS]
                codes[at : at + _ROWS] = _code(axes.turned(_unit(part, max(map(len, part)))), axes.spread)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims), pa.array(codes), *batch.columns], ["dim", "code", *batch.schema.names]
            )

    return order


def _tail(turned: np.ndarray, edge: int) -> np.ndarray:
    return np.sqrt((turned[:, edge:] ** 2).sum(axis=1))


def _tiles(axes: Axes):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims, at = batch.column("dim").to_numpy(), 0
            while at < len(dims):
                dim = int(dims[at])
                run = int(np.argmax(dims[at:] != dim)) if (dims[at:] != dim).any() else len(dims) - at
                size = min(run, max(TILE_BYTES // (8 * dim), 1), 1 << TILE_BITS)
                part = batch.slice(at, size)
                rows = np.stack(_rows_of(part.column("vector")))
                turned = axes.turned(_unit(list(rows), dim))
                lead = turned[:, :BOX_AXES]
                made = {
                    "band": band, "tile": band << 32 | number, "dim": dim, "n": size,
                    "low": lead.min(axis=0).tolist(), "high": lead.max(axis=0).tolist(),
                    "tail": float(_tail(turned, BOX_AXES).max()), "vectors": rows.tobytes(),
                    "digests": part.column("digest").to_pylist(), "weights": part.column("n").to_pylist(),
                }
                kinds = pa.schema([("band", pa.int32()), ("tile", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()),
                    ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("tail", pa.float64()),
                    ("vectors", pa.binary()), ("digests", pa.list_(pa.binary())), ("weights", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_pylist([made], kinds)
                at, number = at + size, number + 1

    return pack


def _reach(a: dict, b: dict) -> float:
    """The largest product of two vectors in boxes ``low`` to ``high`` with suffixes up to ``tail``."""
    lows, highs = (np.asarray(a["low"]), np.asarray(b["low"])), (np.asarray(a["high"]), np.asarray(b["high"]))
    corners = np.stack((lows[0] * lows[1], lows[0] * highs[1], highs[0] * lows[1], highs[0] * highs[1]))
    return float(corners.max(axis=0).sum() + a["tail"] * b["tail"])


class _Tile:
    """A tile as a task holds it, with its turned vectors and suffix lengths made when first needed."""

    def __init__(self, row: dict, axes: Axes):
        self.row, self.axes, self.n = row, axes, int(row["n"])
        self.keys = (np.int64(row["tile"]) << TILE_BITS) + np.arange(self.n)
        self.weights = np.asarray(row["weights"], np.int64)
        self.given = self.unit = self.turned = None

    def open(self) -> None:
        if self.unit is None:
            self.given = np.frombuffer(self.row["vectors"]).reshape(self.n, -1)
            self.unit = _unit(list(self.given), self.given.shape[1])
            exact = self.axes.turned(self.unit)
            self.edges = tuple(e for e in self.axes.edges if e <= exact.shape[1])
            self.turned = exact.astype(np.float32)
            self.tails = [_tail(exact, e).astype(np.float32) for e in self.edges]
            self.first = np.concatenate((self.turned[:, : self.edges[0]], self.tails[0][:, None]), axis=1)

    def compare(self, other: "_Tile", threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (x in this tile, y in the other) of linked pairs, each pair once."""
        for at in range(0, self.n, _ROWS):
            bound = self.first[at : at + _ROWS] @ other.first.T
            x, y = np.nonzero(bound >= threshold - MARGIN)
            for part in range(0, len(x), _PAIRS):
                yield self._narrowed(other, x[part : part + _PAIRS] + at, y[part : part + _PAIRS], threshold)

    def _narrowed(self, other: "_Tile", x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        if other is self:
            x, y = x[x < y], y[x < y]
        sofar = np.einsum("ij,ij->i", self.turned[x, : self.edges[0]], other.turned[y, : self.edges[0]])
        for k in range(1, len(self.edges)):
            a, b = self.edges[k - 1 : k + 1]
            sofar = sofar + np.einsum("ij,ij->i", self.turned[x, a:b], other.turned[y, a:b])
            keep = sofar + self.tails[k][x] * other.tails[k][y] >= threshold - MARGIN
            x, y, sofar = x[keep], y[keep], sofar[keep]
        full = np.einsum("ij,ij->i", self.unit[x], other.unit[y])
        keep = full >= threshold
        return x[keep], y[keep]


def _meet(axes: Axes, threshold: float):
    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        tiles = [_Tile(row, axes) for row in rows.sort_values(["tile"]).to_dict("records")]
        one_band = rows["i"].iloc[0] == rows["j"].iloc[0]
        offsets = np.concatenate(([0], np.cumsum([t.n for t in tiles])))
        keys = np.concatenate([t.keys for t in tiles])
        degree = np.zeros(len(keys), np.int64)
        links = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        for p, a in enumerate(tiles):
            for q in range(p, len(tiles)):
                b = tiles[q]
                if not one_band and a.row["band"] == b.row["band"]:
                    continue
                if a.row["dim"] != b.row["dim"] or _reach(a.row, b.row) < threshold - MARGIN:
                    continue
                a.open(), b.open()
                for x, y in a.compare(b, threshold):
                    degree[offsets[p] : offsets[p + 1]] += np.bincount(x, b.weights[y], a.n).astype(np.int64)
                    degree[offsets[q] : offsets[q + 1]] += np.bincount(y, a.weights[x], b.n).astype(np.int64)
                    fresh.append((x + offsets[p], y + offsets[q]))
                    if sum(len(f[0]) for f in fresh) > _PAIRS:
                        links = spanning(*(np.concatenate(side) for side in zip(links, *fresh)))
                        fresh = []
        links = spanning(*(np.concatenate(side) for side in zip(links, *fresh)))
        root = np.arange(len(keys))
        root[links[0]] = links[1]
        linked = np.flatnonzero(degree)
        return pd.DataFrame({"key": keys[linked], "reached": keys[root[linked]], "degree": degree[linked]})

    return meet


def _meetings(bands: DataFrame, count: int, threshold: float) -> DataFrame:
    """``(i, j)``: the pairs of bands, i <= j, whose boxes let some product reach the threshold."""
    pairs = bands.select("band", F.explode(F.sequence(F.col("band"), F.lit(count - 1))).alias("j")).withColumnRenamed("band", "i")
    a = bands.select(F.col("band").alias("i"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("tail").alias("tail_a"))
    b = bands.select(F.col("band").alias("j"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("tail").alias("tail_b"))
    corner = (
        "aggregate(sequence(0, least(size(low_a), size(low_b)) - 1), 0D, (s, k) -> s + greatest(low_a[k] * low_b[k],"
        " low_a[k] * high_b[k], high_a[k] * low_b[k], high_a[k] * high_b[k])) + tail_a * tail_b"
    )
    reach = F.expr(f"{corner} >= {threshold - MARGIN}D")
    # A band meets itself whatever its box: a vector reaches itself.
    return pairs.join(a, "i").join(b, "j").where(reach | (F.col("i") == F.col("j"))).select("i", "j")


def _bands(spark, rows: int, data_bytes: int) -> int:
    """Enough bands for their size, and for every core to have a meeting."""
    cores = spark.sparkContext.defaultParallelism
    spread = 1
    while spread * (spread + 1) // 2 < 2 * cores:
        spread += 1
    return max(-(-data_bytes // BAND_BYTES), min(spread, -(-rows // 256)), 1)


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``(id, n_links, component_id)`` of every row: how many other vectors it is linked to, and the smallest id it reaches."""
    if not 0 < threshold <= 1:
        raise ValueError(f"The threshold must be above 0 and at most 1, not {threshold}")
    spark = table.sparkSession
    ship_package(spark)
    given = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = given.schema["id"].dataType.simpleString()
    digested = given.mapInArrow(_digests, f"id {kind}, digest binary, vector array<double>")
    rows = materialize(digested.select("id", "digest"), "vector-digests")
    valid = digested.where(F.col("digest").isNotNull())
    distinct = valid.groupBy("digest").agg(F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    distinct = materialize(distinct, "distinct-vectors")
    n, numbers = distinct.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    axes = fit_axes(distinct)
    count = _bands(spark, n, 8 * numbers)
    placed = distinct.mapInArrow(_ordered(axes), "dim int, code bigint, digest binary, n bigint, vector array<double>")
    ranged = placed.repartitionByRange(count, "dim", "code", "digest").sortWithinPartitions("dim", "code", "digest")
    tiles = materialize(ranged.mapInArrow(_tiles(axes), _TILE), "vector-tiles")

    flat = tiles.select("band", F.posexplode(F.arrays_zip("low", "high")).alias("k", "box"), "tail")
    sides = flat.groupBy("band", "k").agg(F.min("box.low").alias("low"), F.max("box.high").alias("high"), F.max("tail").alias("tail"))
    boxes = sides.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("box"), F.max("tail").alias("tail"))
    boxes = boxes.select("band", F.col("box.low").alias("low"), F.col("box.high").alias("high"), "tail")
    meetings = materialize(_meetings(boxes, count, threshold), "band-meetings")
    seats = meetings.select("i", "j", F.col("i").alias("band")).unionByName(
        meetings.where("i <> j").select("i", "j", F.col("j").alias("band"))
    )
    # Pairs of bands are the work, so they are spread over more tasks than cores.
    width = wide(tiles, count * (count + 1) // 2, 1)
    needed = tiles.select("band", "tile", "dim", "n", "low", "high", "tail", "vectors", "weights")
    met = needed.join(seats, "band").repartition(min(width, 1 << 16), "i", "j").groupBy("i", "j")
    links = materialize(met.applyInPandas(_meet(axes, threshold), "key bigint, reached bigint, degree bigint"), "vector-links")

    named = tiles.select("tile", F.posexplode("digests").alias("at", "digest"), "weights")
    named = named.select(
        (F.shiftleft("tile", TILE_BITS) + F.col("at")).alias("key"), "digest", F.get("weights", F.col("at")).alias("weight")
    )
    roots = components(links.where("key <> reached").select(F.col("key").alias("a"), F.col("reached").alias("b")))
    degrees = links.groupBy("key").agg(F.sum("degree").alias("degree"))
    known = named.join(degrees, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = known.select(
        "digest",
        F.coalesce("root", "key").alias("root"),
        (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    known = materialize(known, "vector-classes")
    smallest = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"))
    ids = smallest.join(known, "digest").groupBy("root").agg(F.min("id").alias("component_id"))
    found = known.join(ids, "root").select("digest", "n_links", "component_id")
    # Vectors that link with nothing have no digest; they would be one hot key.
    linked = rows.where(F.col("digest").isNotNull()).join(found, "digest").select("id", "n_links", "component_id")
    alone = rows.where(F.col("digest").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)

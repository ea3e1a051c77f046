"""Near duplicates by 64-bit SimHash and the generalised pigeonhole principle.

A document's fingerprint is the bitwise majority of its shingles' hashes. To
find all pairs within ``distance`` bits, the bits are dealt to partitions that
keep correlated bits together, and each partition i gets t_i + 1 units of
``distance`` + 1 in total: two fingerprints within the distance must differ by
at most t_i bits in some partition with units, else they would differ in more
than ``distance`` bits. Units are allotted by dynamic programming on the
candidate counts that a sample of fingerprints predicts, for several numbers of
partitions; the cheapest design is used. A fingerprint is filed under its own
bits of each partition and probes the cells within t_i bits; members of a cell
are verified on all bits. The design changes the work, never the result.

Cells hold distinct fingerprints, so copies of a text don't meet there. A cell
of more than ``CELL`` members isn't compared pair by pair: its members are filed
under every value within distance / 2 bits, where any two that share a value are
linked and any two linked share a value (of an odd distance, half is rounded up
and those that share a value are compared).

Within a batch of cells links are reduced to a spanning forest, so what is
shuffled grows with the fingerprints and not with their pairs. Components are
found by alternating stars over written rounds.

Defined results: null, empty and blank texts have the fingerprint 0, linked like
any other. Null ids don't count for a component's smallest id; it is null if all
are. Repeated rows get the same result each. An empty table gives an empty
result. Only the columns asked for are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, wide
from corpusloom.llm.components import components
from corpusloom.session import materialize, ship_package

BITS = 64
SHINGLE = 4
DISTANCE = 4
HASH_SEED = 42
# Members that a cell compares pair by pair: as many as the values within two bits of one.
CELL = 2048
# Fingerprints that the design is fitted on; it never changes the result.
SAMPLE = 2048
PARTITIONS = (2, 3, 4, 5)
# Cost of a probe in comparisons: a row that is shuffled against a xor in a batch.
PROBE_COST = 40.0
ROWS_PER_TASK = 1 << 21
# Components of more fingerprints than BIG, and than a MAX_BIG-th of all, are sent to all tasks: MAX_BIG at most.
BIG = 1024
MAX_BIG = 1 << 16
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) < SHINGLE:
        return xxhash.xxh64_intdigest(whole, HASH_SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(found) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), _CHUNK):
        part = zip(first[at : at + _CHUNK], last[at : at + _CHUNK])
        hashes = np.array([digest(whole[a:b], HASH_SEED) for a, b in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), "<u8", batch.num_rows)
        columns = [batch.column(c) for c in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view("<i8"))], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """``(id, key, fp)`` of every row: fingerprints as signed 64-bit numbers; ``key`` is carried along if given."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), *([] if key is None else [key.alias("key")]), F.col(text_col).alias("text")
    )
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_fingerprint_batches, ", ".join([*kinds, "fp bigint"]))


@dataclass(frozen=True)
class Partition:
    """A group of bits with its units: cells within ``units`` - 1 bits are probed; 0 leaves the group out."""

    bits: tuple[int, ...]
    units: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """Masks of the bits to flip, none first."""
        return [
            sum(1 << b for b in chosen) for n in range(self.units) for chosen in combinations(self.bits, n)
        ]


def group_bits(sample: np.ndarray, groups: int) -> list[tuple[int, ...]]:
    """Deals the bits to ``groups`` groups of even width, each grown by the bit most correlated with it."""
    ones = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    ones -= ones.mean(axis=0) if len(ones) else 0
    norm = np.sqrt((ones**2).sum(axis=0))
    related = np.abs(ones.T @ ones) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(related, 0)
    free, found = list(range(BITS)), []
    for k in range(groups):
        width = len(free) // (groups - k)
        inner = related[np.ix_(free, free)]
        group = [free[int(inner.max(axis=1).argmax())]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(related[np.ix_(rest, group)].sum(axis=1).argmax())])
        found.append(tuple(sorted(group)))
        free = [b for b in free if b not in group]
    return found


def _cell_cost(sample: np.ndarray, bits: tuple[int, ...], n: int, most: int) -> list[float]:
    """Cost per fingerprint of 0, 1, ... ``most`` units: probes and the members they are predicted to meet."""
    mask = np.uint64(sum(1 << b for b in bits))
    own = sample & mask
    counts = np.zeros(BITS + 1)
    for at in range(1, len(own)):
        counts += np.bincount(np.bitwise_count(own[at:] ^ own[:-at]), minlength=BITS + 1)
    pairs = max(len(own) * (len(own) - 1) / 2, 1)
    # Never below an even spread: a sample is blind to rare values.
    even = np.cumsum([float(len(list(combinations(bits, k)))) if k < 3 else 0.0 for k in range(most)]) / 2.0 ** len(bits)
    met = np.maximum(np.cumsum(counts)[:most] / pairs, even) * n
    probes = np.cumsum([len(list(combinations(bits, k))) for k in range(most)])
    return [0.0, *(PROBE_COST * probes + met)]


def design(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[Partition]:
    """The partitions and units that cost least for ``n`` fingerprints like those of the sample."""
    best: tuple[float, list[Partition]] | None = None
    most = 3
    for groups in PARTITIONS:
        bits = group_bits(sample, groups)
        cost = [_cell_cost(sample, b, n, most) for b in bits]
        # table[u]: least cost of the partitions so far with u units, and how they are dealt.
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (sofar, dealt) in table.items():
                for u in range(min(most, distance + 1 - used) + 1):
                    option = (sofar + c[u], (*dealt, u))
                    if used + u not in grown or option < grown[used + u]:
                        grown[used + u] = option
            table = grown
        if distance + 1 in table:
            total, dealt = table[distance + 1]
            if best is None or total < best[0]:
                best = (total, [Partition(b, u) for b, u in zip(bits, dealt) if u])
    if best is None:
        raise ValueError(f"No design for a distance of {distance}")
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _probes(partition: Partition) -> Column:
    """A fingerprint's values in this partition: its own first, then those that it probes."""
    own = F.col("fp").bitwiseAND(F.lit(_signed(partition.mask)))
    flips = F.array(*[F.lit(_signed(x)).cast("long") for x in partition.flips()])
    return F.posexplode(F.transform(flips, lambda x: own.bitwiseXOR(x)))


def _cells(prints: DataFrame, partitions: list[Partition]) -> DataFrame:
    """``(part, cell, fp, own)``: every fingerprint under its own cells (``own``) and those it probes."""
    filed = []
    for k, partition in enumerate(partitions):
        probes = prints.select("fp", _probes(partition).alias("at", "cell"))
        filed.append(probes.select(F.lit(k).alias("part"), "cell", "fp", (F.col("at") == 0).alias("own")))
    cells = filed[0]
    for more in filed[1:]:
        cells = cells.unionByName(more)
    return cells


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node of the graph (a, b) to its component's smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _verify(distance: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            sizes = np.diff(members.offsets.to_numpy())
            flat = members.flatten()
            prints, own = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(prints))
            at, lag, found = np.flatnonzero(left > 1), 1, []
            while len(at):
                other = at + lag
                near = np.bitwise_count((prints[at] ^ prints[other]).view(np.uint64)) <= distance
                near &= (own[at] | own[other]) & (prints[at] != prints[other])
                found.append(np.stack((at[near], other[near])))
                lag += 1
                at = at[left[at] > lag]
            if found:
                x, y = np.concatenate(found, axis=1)
                a, b = spanning(prints[x], prints[y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return verify


def _crowded_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints by the values that they share within half the distance.

    Two within an even distance share a value, and two that share one are within
    the distance: each is linked to the smallest at the value. With an odd one,
    half is rounded up, so those at a value are compared.
    """
    near = (distance + 1) // 2
    flips = [sum(1 << b for b in chosen) for n in range(near + 1) for chosen in combinations(range(BITS), n)]
    masks = F.array(*[F.lit(_signed(x)).cast("long") for x in flips])
    filed = prints.select("fp", F.explode(F.transform(masks, lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    # No more members than there are flips, as they are distinct.
    if distance % 2:
        members = F.collect_list(F.struct("fp", F.lit(True).alias("own"))).alias("members")
        shared = filed.groupBy("value").agg(members).where(F.size("members") > 1)
        return shared.select("members").mapInArrow(_verify(distance), "a bigint, b bigint").distinct()
    shared = filed.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return shared.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b").distinct()


def links(prints: DataFrame, distance: int = DISTANCE, sample_rows: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``(fp)`` that connect all pairs within ``distance``."""
    n = prints.count()
    drawn = prints.orderBy(F.xxhash64(F.lit(1), "fp")).limit(sample_rows).toPandas()["fp"].to_numpy(np.int64)
    partitions = design(drawn.view(np.uint64), n, distance)
    cells = _cells(prints, partitions)
    width = wide(prints, n * sum(len(p.flips()) for p in partitions), ROWS_PER_TASK)
    grouped = cells.groupBy("part", "cell")
    crowded = materialize(grouped.count().where(F.col("count") > cell).select("part", "cell"), "crowded-cells")
    any_crowded = bool(crowded.take(1))
    usual = cells.join(crowded, ["part", "cell"], "left_anti") if any_crowded else cells
    members = (
        usual.repartition(width, "part", "cell")
        .groupBy("part", "cell")
        .agg(F.collect_list(F.struct("fp", "own")).alias("members"))
        .where(F.size("members") > 1)
    )
    found = members.select("members").mapInArrow(_verify(distance), "a bigint, b bigint")
    if any_crowded:
        crowd = cells.join(crowded, ["part", "cell"], "left_semi").select("fp").distinct()
        found = found.unionByName(_crowded_links(crowd, distance))
    return found


def classes(rows: DataFrame, distance: int = DISTANCE, **options) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint of ``rows``: equal roots are linked."""
    prints = materialize(rows.select("fp").distinct(), "fingerprints")
    roots = components(links(prints, distance, **options))
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, **options
) -> DataFrame:
    """``(id, fp, component_id)`` of every row; ``component_id`` is the smallest id of the row's component."""
    rows = materialize(fingerprints(docs, id_col, text_col), "document-fingerprints")
    found = materialize(classes(rows, distance, **options), "fingerprint-classes")
    smallest = rows.groupBy("fp").agg(F.min("id").alias("id")).join(found, "fp")
    ids = smallest.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    ids = materialize(ids, "components")
    # A component of very many fingerprints would be one hot key: there are few of these, so they are sent.
    least = max(BIG, (ids.agg(F.sum("members")).first()[0] or 0) // MAX_BIG)
    big = F.broadcast(ids.where(F.col("members") > least).select("root", F.lit(True).alias("big"), F.col("component_id").alias("big_id")))
    marked = found.join(big, "root", "left")
    usual = marked.where("big IS NULL").join(ids, "root").select("fp", "component_id")
    known = usual.unionByName(marked.where("big").select("fp", F.col("big_id").alias("component_id")))
    return rows.join(known, "fp").select("id", "fp", "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, **options
) -> DataFrame:
    """One row of each component, with its columns as they are: that of the smallest id (nulls last).

    Of several rows with that id, the smallest text hash decides, then the hash of
    the whole row, so reruns keep the same row.
    """
    # Maps have no hash.
    whole_row = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = F.struct(F.xxhash64(F.col(text_col)).alias("text"), F.xxhash64(*whole_row).alias("row"))
    rows = materialize(fingerprints(docs, id_col, text_col, hashed), "document-fingerprints")
    found = classes(rows, distance, **options)
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best"))
    kept = best.join(found, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.id").alias("kept_id"), F.col("best.key").alias("kept_key"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), hashed.alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    # What is left of one component are rows that agree in all.
    return whole.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_key"]).select("row.*")

"""Merkle manifest of a dataset: a tree of digests per group, and one over the groups' roots.

H is the lowercase hex SHA-256 of its inputs' concatenation; digests go in as
hex text. The leaves of a group ascend by their key; while a group has several
nodes, every run of ``fanout`` neighbours (the last may be shorter, even one)
becomes the H of its digests. What remains is the group's subroot. The subroots,
by group, null first, are the leaves of one more such tree, whose top is the root.

Slot pivot: a node's children are spread into columns by conditional aggregates,
one column per slot. Concatenating the columns and hashing them makes the node;
concatenating all but a child's own gives the child's siblings. One aggregation
pivots ``fanout`` ** ``depth`` descendants of a node at once, so the levels in
between are columns too, and a tree of n leaves takes log(n) / depth rounds, each
a written table of a ``fanout`` ** ``depth``-th of the rows. Proofs come down the
same tables: a row's slots take its own siblings' columns, then what its parent
has. Nothing is ever gathered per group, and no leaf is joined to anything.

A leaf's place in its group comes from ranges: rows are range-partitioned by
group and key, ranges are counted, and counts summed up. A group that holds most
rows is cut into ranges like any other.

Defined results: a null value enters a leaf as ``-``, so it differs from any
text. Null keys come first; rows with equal keys go by digest, and repeated rows
have a leaf and a proof each. An empty table gives no rows. Only the columns
asked for are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import wide
from corpusloom.session import materialize

FANOUT = 2
# Descendants that one aggregation pivots, at most.
SLOTS = 8
ROWS_PER_TASK = 1 << 20
STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(*values: Column) -> Column:
    """H of the values: ``-`` for null, else UTF-8 byte count, ``:`` and the value (integers in decimal)."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to by its proof."""
    return F.aggregate(steps, digest, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _levels(n: str, fanout: int) -> Column:
    """Levels above the leaves of a tree of n of them."""
    if fanout < 2:
        raise ValueError(f"A node needs at least 2 slots, not {fanout}")
    powers = [1]
    while powers[-1] * fanout < 1 << 62:
        powers.append(powers[-1] * fanout)
    return F.expr(f"size(filter(array({', '.join(f'{p}L' for p in powers)}), p -> p < {n}))")


def _earlier(by: list[str]) -> Column:
    frame = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(frame), F.lit(0).cast("long"))


def _placed(rows: DataFrame) -> DataFrame:
    """``(grp, key, digest, info)`` as ``(tree, pos, leaves, trees, digest, info)``.

    ``tree`` numbers the groups in their order, ``pos`` the leaves of a group;
    ``leaves`` and ``trees`` are how many there are.
    """
    ranges = wide(rows, rows.count(), ROWS_PER_TASK)
    # Equal rows would share one range; their places in the scan tell them apart.
    order = ["grp", "key", "digest", "tie"]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
    ranged = materialize(spread.withColumn("range", F.spark_partition_id()), "merkle-ranges")
    # One row per range and group in it.
    counted = materialize(ranged.groupBy("grp", "range").agg(F.count("*").alias("n")), "merkle-counts")
    # Groups in order lie in ranges in order, so a group's number is a sum over ranges too.
    first = counted.groupBy("grp").agg(F.min("range").alias("range"), F.sum("n").alias("leaves"))
    starts = first.groupBy("range").agg(F.count("*").alias("n"))
    # One row per range.
    starts = starts.select("range", _earlier([]).alias("trees_before"), F.sum("n").over(Window.partitionBy()).alias("trees"))
    inner = Window.partitionBy("range").orderBy("grp")
    groups = first.join(starts, "range").select(
        F.col("grp").alias("grp_"),
        (F.col("trees_before") + F.row_number().over(inner) - 1).alias("tree"),
        "leaves",
        "trees",
    )
    parts = counted.select("grp", "range", _earlier(["grp"]).alias("before"))
    parts = parts.join(groups, F.col("grp").eqNullSafe(F.col("grp_"))).drop("grp")
    within = Window.partitionBy("range", "grp").orderBy("key", "digest", "tie")
    numbered = ranged.withColumn("inner", F.row_number().over(within) - 1).withColumnRenamed("range", "own")
    same = (F.col("own") == F.col("range")) & F.col("grp").eqNullSafe(F.col("grp_"))
    return numbered.join(parts, same).select(
        "tree", (F.col("before") + F.col("inner")).alias("pos"), "leaves", "trees", "digest", "info"
    )


def _pivot(nodes: DataFrame, base: int, fanout: int, depth: int) -> DataFrame:
    """One row per ``fanout`` ** ``depth`` neighbouring nodes of a tree, with the levels between as columns.

    Column ``c<j>_<i>`` is the i-th node j levels up; those of level 0 come with their ``info``.
    """
    width = fanout**depth
    spread = [
        F.expr(f"max(CASE WHEN pos % {width} = {k} THEN struct(digest, info) END) AS child_{k}") for k in range(width)
    ]
    rows = nodes.groupBy("tree", "levels", F.expr(f"pos div {width}").alias("block")).agg(*spread)
    rows = rows.selectExpr("*", *[f"child_{k}.digest AS c0_{k}" for k in range(width)])
    for j in range(depth):
        made = []
        for i in range(width // fanout ** (j + 1)):
            children = [f"c{j}_{i * fanout + m}" for m in range(fanout)]
            node = f"CASE WHEN {children[0]} IS NOT NULL THEN sha2(concat_ws('', {', '.join(children)}), 256) END"
            # A tree whose top is reached has one node left, which stays as it is.
            made.append(f"CASE WHEN levels > {base + j} THEN {node} ELSE {children[0]} END AS c{j + 1}_{i}")
        rows = rows.selectExpr("*", *made)
    return rows


def _siblings(slot: int, base: int, fanout: int, depth: int) -> str:
    """The proof steps of one slot within its row."""
    steps = []
    for j in range(depth):
        at = slot // fanout**j
        first, own = at - at % fanout, at % fanout
        left, right = ([f"c{j}_{first + m}" for m in part] for part in (range(own), range(own + 1, fanout)))
        steps.append(f"struct(concat_ws({', '.join([repr(''), *left])}) AS left, concat_ws({', '.join([repr(''), *right])}) AS right)")
    return f"slice(array({', '.join(steps)}), 1, greatest(least(levels - {base}, {depth}), 0))"


class Trees:
    """Trees over nodes ``(tree, pos, levels, digest, info)``, ``pos`` from 0 without gaps in each tree."""

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT):
        self.fanout = fanout
        self.depth = 1
        while fanout ** (self.depth + 1) <= SLOTS:
            self.depth += 1
        top = nodes.agg(F.max("levels")).first()[0] or 0
        self.rounds: list[DataFrame] = []
        while True:
            base = len(self.rounds) * self.depth
            rows = materialize(_pivot(nodes, base, fanout, self.depth), f"merkle-level-{base}")
            self.rounds.append(rows)
            if base + self.depth >= top:
                break
            none = F.struct(F.lit(None).cast("int").alias("none"))
            nodes = rows.select(
                "tree", F.col("block").alias("pos"), "levels", F.col(f"c{self.depth}_0").alias("digest"), none.alias("info")
            )

    def tops(self) -> DataFrame:
        """``(tree, top)``: one row per tree."""
        return self.rounds[-1].select("tree", F.col(f"c{self.depth}_0").alias("top"))

    def leaves(self, above: DataFrame) -> DataFrame:
        """``(tree, pos, digest, info, steps, given)`` of every leaf, from ``(tree, steps, given)`` per tree.

        ``steps`` are the leaf's siblings level by level, then those given for its tree.
        """
        down = above.select("tree", F.lit(0).cast("long").alias("block"), F.col("steps").alias("upper"), "given")
        width = self.fanout**self.depth
        for number in reversed(range(len(self.rounds))):
            rows = self.rounds[number].join(down, ["tree", "block"])
            base = number * self.depth
            slots = [
                f"struct(block * {width} + {k} AS pos, child_{k} AS child,"
                f" concat({_siblings(k, base, self.fanout, self.depth)}, upper) AS steps)"
                for k in range(width)
            ]
            # Empty slots make no rows.
            taken = F.expr(f"explode(filter(array({', '.join(slots)}), s -> s.child IS NOT NULL))")
            each = rows.select("tree", "given", taken.alias("s"))
            down = each.selectExpr("tree", "s.pos AS block", "s.steps AS upper", "given", "s.child AS child")
            if number:
                down = down.drop("child")
        return down.select(
            "tree", F.col("block").alias("pos"), "child.digest", "child.info", F.col("upper").alias("steps"), "given"
        )


def manifest(
    docs: DataFrame, digest: Column, group: Column, key: Column, info: Column, fanout: int = FANOUT
) -> DataFrame:
    """``(info, digest, subroot, root, steps)`` of every row of ``docs``.

    ``digest`` is the row's leaf, ``info`` a struct to carry along, ``steps`` the
    proof: the siblings left and right of the way up, level by level.
    """
    levels = _levels("leaves", fanout)
    rows = docs.select(group.alias("grp"), key.alias("key"), digest.alias("digest"), info.alias("info"))
    placed = materialize(_placed(rows), "merkle-leaves")
    nodes = placed.select("tree", "pos", levels.alias("levels"), "digest", "info")
    groups = Trees(nodes, fanout)
    # As many rows as groups.
    count = placed.agg(F.max("trees")).first()[0] or 0
    top_nodes = groups.tops().select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("pos"),
        _levels(str(count), fanout).alias("levels"),
        F.col("top").alias("digest"),
        F.struct("tree").alias("info"),
    )
    over = Trees(top_nodes, fanout)
    start = over.tops().select("tree", F.array().cast(STEPS).alias("steps"), F.struct(F.col("top").alias("root")).alias("given"))
    subroots = over.leaves(start).select(
        F.col("info.tree").alias("tree"),
        "steps",
        F.struct(F.col("digest").alias("subroot"), F.col("given.root").alias("root")).alias("given"),
    )
    found = groups.leaves(materialize(subroots, "merkle-subroots"))
    return found.select("info", "digest", "given.subroot", "given.root", "steps")

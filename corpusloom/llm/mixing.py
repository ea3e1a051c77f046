"""Mixing sources to target weights by pivotal rounding.

A source's target over its size is the number of copies that each of its
documents is due: whole copies for certain, and a fraction that must be rounded
to none or one. Two fractional documents are paired and words move from one to
the other, up or down at random so that neither's expectation changes, until one
of them has no fraction left. The pair's words stay the same, so a source's
words miss its target by less than its last document. Blocks of documents are
folded in parallel; what a block leaves over is one fractional document, and the
leftovers are folded again, level by level, until each source has one, which a
draw rounds.

All draws depend on the seed, the level and the documents only: reruns agree.

Defined results: a null text has no words; a document without words takes none,
whatever its copies. A null source is a source like any other and the last in
order. Rows that agree in source, id, text are decided together: they get the
copies that their fractions add up to, and the fraction of one row that is left
is rounded like any other. An empty table gives an empty result. Only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import bind, unit_draw, words
from corpusloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
# Documents per fold; a level's leftovers are a BLOCK-th of its documents.
BLOCK = 64
SEED = 11


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """``(source, source_size, n, target)`` from one row ``(source, source_size, n)`` per source.

    ``share`` of all words is dealt by weight. A source that would get more than
    ``max_copies`` times its size gets that, and the rest is dealt anew. In order
    of cap per unit of weight the capped sources come first, so running sums find
    the level at which it stops. One row per source, as many as there are weights
    to set, so the running sums need no partitions.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(pattern, (F.row_number().over(by_name) - 1) % len(weights)))
    capped = weighed.withColumn("cap", max_copies * F.col("source_size").cast("double"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # What one unit of weight gets if just the sources before this one are capped.
    level = (
        share * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    levels = capped.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level"))))
    water = fits.over(whole)["level"]
    target = F.coalesce(F.least(F.col("cap"), water * F.col("weight")), F.col("cap"))
    return levels.withColumn("target", target).select("source", "source_size", "n", "target")


def _fold(level: int, seed: int) -> Column:
    """Folds the array ``docs`` of ``(draw key, unit, mass, p)`` into ``done`` documents and one ``rest``.

    ``mass`` is the words that a copy brings; the rest's p is strictly between 0 and 1, or the rest is null.
    """
    unit = "struct<key:bigint,unit:struct<doc_id:bigint,source:string,th:bigint>,mass:bigint,p:double>"

    def done(doc: Column, up: Column) -> Column:
        return F.struct(doc["key"].alias("key"), doc["unit"].alias("unit"), up.alias("up"))

    def left(doc: Column, p: Column) -> Column:
        return F.struct(doc["key"].alias("key"), doc["unit"].alias("unit"), doc["mass"].alias("mass"), p.alias("p"))

    none = F.lit(None).cast(unit)

    def pair(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        # a may gain up to alpha words from b, or b up to beta from a.
        masses = F.struct(
            ((1 - a["p"]) * a["mass"]).alias("a_up"),
            (a["p"] * a["mass"]).alias("a_down"),
            ((1 - b["p"]) * b["mass"]).alias("b_up"),
            (b["p"] * b["mass"]).alias("b_down"),
            unit_draw(F.lit(seed), F.lit(level), a["key"], b["key"]).alias("draw"),
        )

        def move(x: Column) -> Column:
            alpha, beta = F.least(x["a_up"], x["b_down"]), F.least(x["a_down"], x["b_up"])
            gains = x["draw"] * (alpha + beta) < beta
            return F.struct(
                gains.alias("gains"),
                F.when(gains, alpha).otherwise(-beta).alias("words"),
                F.when(gains, x["a_up"] <= x["b_down"]).otherwise(x["a_down"] <= x["b_up"]).alias("a_ends"),
                F.when(gains, x["b_down"] <= x["a_up"]).otherwise(x["b_up"] <= x["a_down"]).alias("b_ends"),
            )

        def ended(x: Column) -> Column:
            both = x["a_ends"] & x["b_ends"]
            a_done, b_done = done(a, x["gains"]), done(b, ~x["gains"])
            now = F.when(both, F.array(a_done, b_done)).when(x["a_ends"], F.array(a_done)).otherwise(F.array(b_done))
            a_left, b_left = left(a, a["p"] + x["words"] / a["mass"]), left(b, b["p"] - x["words"] / b["mass"])
            rest = F.when(both, none).when(x["a_ends"], b_left).otherwise(a_left)
            return F.struct(rest.alias("rest"), F.concat(acc["done"], now).alias("done"))

        return bind(masses, lambda m: bind(move(m), ended))

    start = F.struct(
        none.alias("rest"),
        F.array().cast("array<struct<key:bigint,unit:struct<doc_id:bigint,source:string,th:bigint>,up:boolean>>").alias("done"),
    )
    return F.aggregate(
        "docs",
        start,
        lambda acc, b: F.when(acc["rest"].isNull(), F.struct(left(b, b["p"]).alias("rest"), acc["done"].alias("done"))).otherwise(pair(acc, b)),
    )


def round_pivotal(fractions: DataFrame, largest: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Rounds ``(unit, mass, p)`` with 0 < p < 1 to ``(unit, up)``, source by source.

    ``largest`` is the number of rows of the largest source. Blocks are dealt by
    hash, so a source of any size is many groups of about ``block`` documents.
    """
    left = fractions.select(
        F.xxhash64(F.lit(seed), "unit.doc_id", "unit.source", "unit.th").alias("key"), "unit", "mass", "p", "n"
    )
    decided, level = [], 0
    while True:
        groups = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
        dealt = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "key"), groups)
        folded = (
            left.groupBy(F.col("unit.source").alias("source"), dealt.alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("key", "unit", "mass", "p"))).alias("docs"), F.max(groups).alias("n"))
            .select(_fold(level, seed).alias("fold"), "n")
        )
        folded = materialize(folded, f"mix-level-{level}")
        decided.append(folded.select(F.explode("fold.done").alias("x")).select("x.unit", "x.up"))
        left = folded.where("fold.rest is not null").select("fold.rest.*", "n")
        # Blocks of a level are the documents of the next.
        if largest <= block:
            break
        largest, level = -(-largest // block), level + 1
    last = left.select("unit", (unit_draw(F.lit(seed + 2), F.col("key")) < F.col("p")).alias("up"))
    for part in decided:
        last = last.unionByName(part)
    return last


def _decided(
    docs: DataFrame, weights: Sequence[float], share: float, max_copies: int, id_col: str, text_col: str, source_col: str, seed: int
) -> DataFrame:
    """``(doc_id, source, th, size, rows, source_size, target, whole, extra)`` per distinct (id, source, text).

    Each of the ``rows`` equal rows is taken ``whole`` times, and ``extra`` of them once more.
    """
    text = F.col(text_col)
    units = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            text_hash(text).alias("th"),
            F.size(words(text)).cast("long").alias("size"),
        )
        .groupBy("doc_id", "source", "th", "size")
        .agg(F.count("*").alias("rows")),
        "mix-units",
    )
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")
    )
    targets = materialize(source_targets(sizes, weights, share, max_copies), "mix-targets")
    largest = targets.agg(F.max("n")).first()[0] or 0
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    # Equal rows are dealt the copies that their fractions make together; what is left is a fraction of one row.
    shared = (
        units.withColumnRenamed("source", "unit_source")
        .join(targets, F.col("unit_source").eqNullSafe(F.col("source")))
        .drop("unit_source")
        .withColumn("due", due)
        .withColumn("more", F.col("rows") * (F.col("due") - F.floor("due")))
        .withColumn("p", F.col("more") - F.floor("more"))
    )
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    unit = F.struct("doc_id", "source", "th")
    rounded = round_pivotal(
        shared.where(open_).select(unit.alias("unit"), F.col("size").alias("mass"), "p", "n"), largest, seed
    )
    # Rounding hands back each unit once; adding it up needs no join.
    facts = {"size": "long", "rows": "long", "source_size": "long", "target": "double", "whole": "long"}
    key = ["doc_id", "source", "th"]
    parts = shared.withColumn("whole", F.floor("due").cast("long"))
    parts = parts.select(*key, *facts, F.floor("more").cast("long").alias("extra")).unionByName(
        rounded.select("unit.*", *[F.lit(None).cast(t).alias(c) for c, t in facts.items()], F.col("up").cast("long").alias("extra"))
    )
    return parts.groupBy(*key).agg(*[F.max(c).alias(c) for c in facts], F.sum("extra").alias("extra"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, source, th, size, rows, source_size, target, copies)``: ``rows`` equal rows are taken ``copies`` times each.

    ``th`` is the text's hash. Rows that agree in id, source and text are one row
    here, or two if some of them are taken once more than the others.
    """
    decided = _decided(docs, weights, share, max_copies, id_col, text_col, source_col, seed)
    parts = F.array(
        F.struct((F.col("rows") - F.col("extra")).alias("rows"), F.col("whole").alias("copies")),
        F.struct(F.col("extra").alias("rows"), (F.col("whole") + 1).alias("copies")),
    )
    split = decided.withColumn("part", F.explode(F.filter(parts, lambda x: x["rows"] > 0)))
    return split.select("doc_id", "source", "th", "size", "part.rows", "source_size", "target", "part.copies")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its columns as they are."""
    decided = _decided(docs, weights, share, max_copies, id_col, text_col, source_col, seed)
    names = ("doc_id", "source", "th", "rows", "whole", "extra")
    taken = materialize(decided.select(*[F.col(c).alias(f"mix_{c}") for c in names]), "mix-taken")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    same = (
        F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("mix_doc_id"))
        & F.col(f"row.{source_col}").cast("string").eqNullSafe(F.col("mix_source"))
        & text_hash(F.col(f"row.{text_col}")).eqNullSafe(F.col("mix_th"))
    )
    some = (F.col("mix_extra") > 0) & (F.col("mix_extra") < F.col("mix_rows"))
    alike = taken.where(~some).withColumn("mix_copies", F.col("mix_whole") + (F.col("mix_extra") > 0).cast("long"))
    joined = rows.join(alike.where("mix_copies > 0"), same).select("row", "mix_copies")
    if taken.where(some).take(1):
        # Rows that agree in id, source and text may differ elsewhere: those that agree in all are counted first.
        unit = ["mix_doc_id", "mix_source", "mix_th", "mix_whole", "mix_extra"]
        counted = rows.join(taken.where(some), same).groupBy(*unit, "row").agg(F.count("*").alias("mix_n"))
        earlier = Window.partitionBy(*unit).orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("mix_n").over(earlier), F.lit(0))
        more = F.greatest(F.least(F.col("mix_extra") - before, F.col("mix_n")), F.lit(0))
        dealt = counted.withColumn("mix_copies", F.col("mix_n") * F.col("mix_whole") + more)
        joined = joined.unionByName(dealt.where("mix_copies > 0").select("row", "mix_copies"))
    repeated = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return repeated.select("row.*")

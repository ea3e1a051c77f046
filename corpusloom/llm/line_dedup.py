"""Removal of lines that many sites share.

A line is known by its hash. Every task sketches the sites of its lines
(HyperLogLog), and the sketches of a line are merged. An estimate clear of the
threshold decides, and lines near it get an exact count of their sites. Lines on
``min_sites`` sites or more are taken out of every document.

A line that a third of all documents hold is one sketch per task, or one row per
site where it is counted, before anything is joined. Where at most
``FILTERED_LINES`` lines are shared, they are filtered where the texts are
scanned; otherwise removing needs one shuffle of the texts, with the same result.

Defined results: lines are compared without the white space around them; lines
without a word are never removed. A null text has no lines and stays null. A
null site is no site. Repeated rows count like one as far as sites go. An empty
table gives an empty result. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES
from corpusloom.session import materialize

MIN_SITES = 10
# log2 of the sketches' registers: 1.6 % standard error. Estimates within BAND of the threshold are counted.
SKETCH_BITS = 12
BAND = 0.1
# Shared lines up to which they are filtered in the scan, and near ones up to which they are sent to all tasks.
FILTERED_LINES = 2000
SENT_LINES = 1 << 20


def line_hash(line: Column) -> Column:
    """Null for a line without a word."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare != "", F.xxhash64(bare))


def hashes(text: Column) -> Column:
    """Hashes of all lines in order, null for those without a word."""
    return F.transform(F.split(text, "\n", -1), line_hash)


def shared_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", band: float = BAND
) -> DataFrame:
    """``(line)``: hashes of the lines on ``min_sites`` sites or more."""
    lines = docs.select(
        F.col(site_col).cast("string").alias("site"), F.explode(hashes(F.col(text_col))).alias("line")
    ).where("line is not null and site is not null")
    # Each task sketches the sites of its lines, and sketches of a line are merged: no pair of line and site is moved.
    sketch = F.hll_sketch_agg("site", SKETCH_BITS)
    seen = lines.groupBy("line").agg(F.count("*").alias("n"), F.hll_sketch_estimate(sketch).alias("sites"))
    spread = materialize(seen.where(F.col("n") >= min_sites).select("line", "sites"), "line-sites")
    margin = max(1.0, band * min_sites)
    clear = spread.where(F.col("sites") > min_sites + margin).select("line")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("line")
    if near.count() <= SENT_LINES:
        pairs = lines.join(F.broadcast(near), "line").groupBy("line", "site").agg(F.lit(1).alias("one"))
    else:
        # A line on many rows is one row per site before it is joined.
        pairs = lines.groupBy("line", "site").agg(F.lit(1).alias("one")).join(near, "line")
    counted = pairs.groupBy("line").agg(F.count("*").alias("sites"))
    exact = counted.where(F.col("sites") >= min_sites).select("line")
    return materialize(clear.unionByName(exact), "shared-lines")


def remove_shared_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    band: float = BAND,
) -> DataFrame:
    """``(row, kept_text, n_lines, n_removed)`` of every row: the row as it was, and its text without the shared lines."""
    shared = shared_lines(docs, min_sites, text_col, site_col, band)
    listed = [r["line"] for r in shared.limit(FILTERED_LINES + 1).collect()]
    if len(listed) <= FILTERED_LINES:
        # Few enough to be part of the scan's own expressions: no text is moved.
        found = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
        gone = (lambda line: F.coalesce(line_hash(line).isin(listed), F.lit(False))) if listed else (lambda line: F.lit(False))
        return _without(found.withColumn("kept", F.filter(F.split("text", "\n", -1), lambda line: ~gone(line))))
    key = [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")]
    lines = docs.select(*key, F.explode(F.array_distinct(hashes(F.col(text_col)))).alias("line")).where("line is not null")
    # No more per document than it has different lines.
    found = lines.join(shared, "line", "left_semi").groupBy("id", "th").agg(F.collect_set("line").alias("shared"))
    found = found.select(F.col("id").alias("found_id"), F.col("th").alias("found_th"), "shared")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), *key)
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    lines_of = F.split("text", "\n", -1)
    stays = F.filter(lines_of, lambda line: ~F.coalesce(F.array_contains("shared", line_hash(line)), F.lit(False)))
    kept = F.when(F.col("shared").isNull(), lines_of).otherwise(stays)
    return _without(joined.withColumn("kept", kept))


def _without(rows: DataFrame) -> DataFrame:
    lines_of = F.split("text", "\n", -1)
    return rows.select(
        "row",
        F.array_join("kept", "\n").alias("kept_text"),
        F.coalesce(F.size(lines_of), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines_of) - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )

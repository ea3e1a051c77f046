"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import delete_path, new_path


def _written(edges: DataFrame) -> tuple[str, DataFrame]:
    spark = edges.sparkSession
    path = new_path(spark, "links")
    edges.write.parquet(path)
    return path, spark.read.schema(edges.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in the links ``(a, b)`` but the roots: the smallest node that it reaches.

    Each round is a written table: nothing is recomputed when executors are
    lost. A node's neighbours are never gathered, so a hub is no large group;
    sums are taken before rows move, and joins on a hub's key can be split.
    """
    spark = links.sparkSession
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    path, edges = _written(links.where("a <> b").select(larger.alias("u"), smaller.alias("v")).distinct())

    def state(table: DataFrame) -> tuple:
        mark = F.xxhash64("u", "v").cast("decimal(38,0)")
        return tuple(table.agg(F.count("*"), F.sum(mark), F.sum(F.hash("v", "u").cast("long"))).first())

    before = state(edges)
    while before[0]:
        old = path
        path, edges = _written(_small_star(_large_star(edges)))
        delete_path(spark, old)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

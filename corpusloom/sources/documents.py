"""Document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.stream import first_documents

# Fixed names: corpus size -> (subset of the document source, folder of its shards).
CORPUS_VERSIONS = {
    "10B": ("sample-10BT", "fineweb_edu_10bt"),
    "100B": ("sample-100BT", "fineweb_edu_100bt"),
    "350B": ("sample-350BT", "fineweb_edu_350bt"),
}


def corpus_paths(version: str, root: str, output_dir: str | None = None) -> tuple[str, str]:
    """(document path below ``root``, shard folder) of a named corpus size."""
    if version not in CORPUS_VERSIONS:
        raise ValueError(f"There is no corpus of size {version!r}; sizes are {', '.join(CORPUS_VERSIONS)}")
    subset, folder = CORPUS_VERSIONS[version]
    return f"{root.rstrip('/')}/{subset}", output_dir or f"data/{folder}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartitions by key if the scan has fewer tasks than the cluster has cores.

    Spark splits files, so that means a table of less than a scan task's bytes
    per core; the text of anything larger isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def scan_documents(
    spark: SparkSession, path: str, max_docs: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """documents(key, text); nothing else is read."""
    documents = spark.read.parquet(path).select(key, text)
    return spread(first_documents(documents, max_docs, key), key)

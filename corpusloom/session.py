"""Session defaults and tables written between stages."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# 128 MB as INT.
TOKENS_PER_TASK = 1 << 25

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cpus: str = "8", app_name: str = "corpusloom", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # A group of an array aggregate is one window or batch here, so many fit in memory.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, which import it to run the data source.

    The archive is made on the driver, as with ``--py-files``; Spark hands it out.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom")
    root, name = os.path.split(package)
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, name))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the session names it.

    Only a local-mode session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local_dirs[app]


def shuffle_width(spark: SparkSession, tokens: int) -> int | None:
    """Partitions for a shuffle of so many tokens; None if the session's number is enough.

    Adaptive execution merges small partitions but doesn't add any.
    """
    wanted = -(-tokens // TOKENS_PER_TASK)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/corpusloom/{app}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there, in whatever file system Spark finds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_tables(spark: SparkSession) -> None:
    """Deletes all that this application materialized; DataFrames that read it can't be run after that."""
    app = spark.sparkContext.applicationId
    delete_path(spark, f"{shared_dir(spark)}/corpusloom/{app}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Cuts the lineage in a way that survives lost executors, and lets later
    stages prune columns that a checkpointed DataFrame would carry along.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

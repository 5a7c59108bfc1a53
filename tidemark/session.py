"""Session defaults the operators rely on."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Tasks get the package's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["tidemark"])

# All are runtime settings, so an existing session can be configured too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Merge shuffle partitions down to the number of cores, not to a size: windows, fits and
    # generated calendars cost far more per byte than a plain shuffle read.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for name, value in RUNTIME_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def get_session(
    app: str = "tidemark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def settled(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan starts anew from there.

    Used where one result feeds several branches, or a chain of them: without it every branch
    would run its whole history again. A lost executor re-reads files.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_by(df: DataFrame, key: str) -> DataFrame:
    """As ``settled``, in buckets of a column: joins by that column need not move these rows again."""
    spark, name = df.sparkSession, f"tidemark_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).saveAsTable(name, "parquet", path=path)
    _drop_at_end(spark, path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are no managed table's, and stay
    return table


def settled_in_place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``settled_by``, for rows that already lie with their keys: each task writes the buckets it has.

    Nothing is moved. A task sorts its rows by bucket, so that it has one file open at a time.
    """
    spark, name = df.sparkSession, f"tidemark_{uuid.uuid4().hex}"
    path, n = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).saveAsTable(name, "parquet", path=path)
    _drop_at_end(spark, path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _drop_at_end(spark: SparkSession, path: str) -> None:
    """Tables that cut lineage live as long as the driver: their file system deletes them then."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local run without that setting
    gets a temporary folder; on a cluster an executor could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
    return _local_dir()

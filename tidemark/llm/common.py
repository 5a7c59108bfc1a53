"""Input rules and session settings that the operators of this folder share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure, settled, settled_by

__all__ = ["blocks_of", "documents_of", "folder", "forget", "per_worker", "read", "settled", "settled_by", "tuned"]

# Arrow batches are bounded by bytes as well as rows, so a run of long texts does not pile up.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def tuned(spark: SparkSession) -> SparkSession:
    for name, value in BATCH_CONF.items():
        spark.conf.set(name, value)
    return configure(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(docs: DataFrame, *extra: str, null_text: str | None = "") -> DataFrame:
    """``doc_id`` and ``text`` alone (and ``extra``), so other columns can have any name.

    Rows without a doc_id stay out: nothing could refer to them. A NULL text becomes
    ``null_text``.
    """
    text = F.col("text") if null_text is None else F.coalesce("text", F.lit(null_text))
    keep = [F.col(f"`{c}`") for c in extra]
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *keep
    )


def folder(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def blocks_of(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of at most about ``most`` bytes of a column: arrays over them stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        reach = (ends[at - 1] if at else 0) + most
        stop = max(at + 1, int(np.searchsorted(ends, reach, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task: for caches of bounded size alone.

    Functions travel to workers by value, so their module's globals last for one task only.
    """
    held = sys.modules.setdefault("tidemark_worker", types.ModuleType("tidemark_worker")).__dict__
    if key not in held:
        forget()
        held[key] = make()
    return held[key]


def forget() -> None:
    """Give back what earlier tasks of this Python worker keep, before work that needs room of its own."""
    held = sys.modules.get("tidemark_worker")
    kept = [k for k in held.__dict__ if isinstance(k, tuple)] if held else []
    for key in kept:
        del held.__dict__[key]
    if kept and sys.platform == "linux":  # freed blocks go back to the system as well
        ctypes.CDLL(None).malloc_trim(0)

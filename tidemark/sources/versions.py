"""Versioned datasets: Parquet folders and a catalogue table that names them.

A version is one folder ``{category}/{subcategory}/{prefix}/v{nnn}``. The catalogue is a Parquet
dataset with one row per event (saved or expired), to which writers only add; the newest event
of a version says whether it is live. A reader therefore sees either all of a version or none.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOGUE_SCHEMA = (
    "category string, subcategory string, prefix string, version int, version_id string, "
    "created timestamp, metadata string, path string, live boolean"
)
# The kinds of feature frames and the version stamp's format.
FEATURE_TYPES = ("lag", "rolling", "calendar", "scaled", "prepared")
STAMP = "yyyyMMdd_HHmmss"


# --- operators over a catalogue frame -------------------------------------------------------------------


def newest_versions(catalogue: DataFrame, by: Sequence[str] = ("category", "subcategory", "prefix")) -> DataFrame:
    """Newest version of every group."""
    return catalogue.groupBy(*by).agg(
        F.max_by("version_id", "version").alias("version_id"), F.max("version").alias("version")
    )


def list_versions(catalogue: DataFrame, prefix: str | None = None) -> DataFrame:
    """Version ids with their position, oldest first, optionally of one prefix."""
    if prefix is not None:
        catalogue = catalogue.filter(F.col("prefix") == prefix)
    # A catalogue holds one row per saved dataset.
    w = Window.partitionBy("category", "subcategory", "prefix").orderBy("version")
    return catalogue.select(
        "category", "subcategory", "prefix", "version_id", F.row_number().over(w).alias("position")
    )


def expired_versions(catalogue: DataFrame, keep_last: int = 5) -> DataFrame:
    """Versions that are not among the newest ``keep_last`` of their prefix."""
    w = Window.partitionBy("category", "subcategory", "prefix").orderBy(F.desc("version"))
    return catalogue.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > keep_last).drop("_r")


def kept_versions(catalogue: DataFrame, keep_last: int = 5) -> DataFrame:
    gone = expired_versions(catalogue, keep_last).select("category", "subcategory", "prefix", "version")
    return catalogue.join(gone, ["category", "subcategory", "prefix", "version"], "left_anti")


def version_id(prefix: str, version: int, stamp: str) -> str:
    return f"{prefix}_{stamp}_v{version:03d}"


# --- the store --------------------------------------------------------------------------------------------


class VersionStore:
    """Save, load, list and expire versions under one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalogue_path = f"{self.root}/_catalogue"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def catalogue(self) -> DataFrame:
        """Live versions."""
        fs, path = self._fs(self.catalogue_path)
        if not fs.exists(path):
            return self.spark.createDataFrame([], CATALOGUE_SCHEMA)
        events = self.spark.read.schema(CATALOGUE_SCHEMA + ", seq long").parquet(self.catalogue_path)
        last = F.max_by(F.struct("version_id", "created", "metadata", "path", "live"), "seq")
        newest = events.groupBy("category", "subcategory", "prefix", "version").agg(last.alias("_e"))
        return newest.select("category", "subcategory", "prefix", "version", "_e.*").filter("live")

    def _record(self, rows: DataFrame) -> None:
        stamped = rows.withColumn("seq", F.unix_micros(F.current_timestamp()))
        stamped.coalesce(1).write.mode("append").parquet(self.catalogue_path)

    def _last_version(self, category: str, sub: str, prefix: str) -> int:
        fs, path = self._fs(self.catalogue_path)
        if not fs.exists(path):
            return 0
        # Expired versions count as well, so numbers are never used twice.
        events = self.spark.read.schema(CATALOGUE_SCHEMA).parquet(self.catalogue_path)
        row = self._of(events, category, sub, prefix).agg(F.max("version").alias("v")).first()
        return row["v"] or 0

    @staticmethod
    def _of(df: DataFrame, category: str, sub: str | None, prefix: str | None) -> DataFrame:
        for name, value in (("category", category), ("subcategory", sub), ("prefix", prefix)):
            if value is not None:
                df = df.filter(F.col(name) == value)
        return df

    def save(
        self, df: DataFrame, category: str, sub: str, prefix: str, metadata: dict | None = None,
        partition_by: Sequence[str] = (),
    ) -> str:
        """Write the next version and then its catalogue row; returns the version id."""
        version = self._last_version(category, sub, prefix) + 1
        path = f"{self.root}/{category}/{sub}/{prefix}/v{version:03d}"
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        now = self.spark.range(1).select(
            F.current_timestamp().alias("created"), F.date_format(F.current_timestamp(), STAMP).alias("s")
        ).first()
        vid = version_id(prefix, version, now["s"])
        row = (category, sub, prefix, version, vid, now["created"], json.dumps(metadata or {}, default=str), path, True)
        self._record(self.spark.createDataFrame([row], CATALOGUE_SCHEMA))
        return vid

    def _find(self, category: str, sub: str, prefix: str | None = None, version: str | None = None):
        found = self._of(self.catalogue(), category, sub, prefix)
        if version is not None:
            found = found.filter(F.col("version_id") == version)
        return found.orderBy(F.desc("created"), F.desc("version")).first()

    def load(self, category: str, sub: str, prefix: str | None = None, version: str | None = None) -> DataFrame:
        """An exact version, else the newest of the prefix."""
        row = self._find(category, sub, prefix, version)
        if row is None:
            raise FileNotFoundError(f"no version of {category}/{sub}/{prefix or version}")
        return self.spark.read.parquet(row["path"])

    def metadata(self, category: str, sub: str, prefix: str | None = None, version: str | None = None) -> dict:
        row = self._find(category, sub, prefix, version)
        if row is None:
            raise FileNotFoundError(f"no version of {category}/{sub}/{prefix or version}")
        return json.loads(row["metadata"])

    def latest(self, category: str, sub: str, prefix: str) -> str | None:
        row = self._find(category, sub, prefix)
        return row["version_id"] if row else None

    def versions(self, category: str, sub: str, prefix: str | None = None) -> list[str]:
        rows = self._of(self.catalogue(), category, sub, prefix).orderBy("created", "version")
        return [r["version_id"] for r in rows.select("version_id").collect()]

    def expire(self, category: str, sub: str, prefix: str | None = None, keep_last: int = 5) -> int:
        """Mark old versions as gone in the catalogue, then delete their folders."""
        old = expired_versions(self._of(self.catalogue(), category, sub, prefix), keep_last)
        rows = old.select("category", "subcategory", "prefix", "version", "version_id", "created", "metadata", "path").collect()
        if not rows:
            return 0
        gone = self.spark.createDataFrame([(*r, False) for r in rows], CATALOGUE_SCHEMA)
        self._record(gone)
        for r in rows:
            fs, path = self._fs(r["path"])
            fs.delete(path, True)
        return len(rows)

    # --- named kinds of datasets ---

    def save_features(self, df: DataFrame, kind: str, metadata: dict | None = None) -> str:
        if kind not in FEATURE_TYPES:
            raise ValueError(f"unknown feature type {kind!r}; one of {FEATURE_TYPES}")
        return self.save(df, "data", "features", f"{kind}_features", metadata)

    def load_latest_features(self) -> DataFrame:
        """Newest indicator frame, else the newest cleaned frame."""
        for prefix in ("technical_indicators", "cleaned_data"):
            if self.latest("data", "interim", prefix) is not None:
                return self.load("data", "interim", prefix)
        raise FileNotFoundError("neither indicators nor cleaned data have been saved")

    def save_model(self, params: DataFrame, name: str = "forecaster", metadata: dict | None = None) -> str:
        """A model is its table of fitted parameters, one row per key."""
        return self.save(params, "models", "trained", name, metadata)

    def load_model(self, name: str = "forecaster", version: str | None = None) -> DataFrame:
        return self.load("models", "trained", name, version)

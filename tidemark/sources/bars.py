"""Loading, ranges, bars and file sinks."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.series import Series, normalise, series, slots

# Fixed value: the bar sizes that callers may name.
ALLOWED_INTERVALS = (
    "1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d", "1wk", "1mo", "3mo",
)
_SECONDS = {"m": 60, "h": 3600, "d": 86400}
_TRUNC = {"1wk": "week", "1mo": "month", "3mo": "quarter"}
_TRUNC_SECONDS = {"1wk": 7 * 86400, "1mo": 28 * 86400, "3mo": 90 * 86400}

BAR_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ds", T.TimestampType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("Volume", T.DoubleType()),
    ]
)
# Names that may hold the target, in order of preference.
TARGET_FALLBACKS = ("Adj_Close", "Adjusted_Close", "Close")


def interval_seconds(interval: str) -> int:
    """Shortest length of the interval in seconds; raises on a size that is not allowed."""
    if interval not in ALLOWED_INTERVALS:
        raise ValueError(f"interval must be one of {ALLOWED_INTERVALS}, got {interval!r}")
    if interval in _TRUNC_SECONDS:
        return _TRUNC_SECONDS[interval]
    return int(interval[:-1]) * _SECONDS[interval[-1]]


def bar_start(ts: Column, interval: str) -> Column:
    seconds = interval_seconds(interval)
    if interval in _TRUNC:
        return F.date_trunc(_TRUNC[interval], ts)
    return F.window(ts, f"{seconds} seconds")["start"]


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Read files with an explicit schema (Parquet carries its own); NaN becomes NULL."""
    if schema is None and fmt != "parquet":
        raise ValueError("text formats need a schema; inference reads the data twice")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return normalise(reader.format(fmt).load(path))


def load_bars(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str] | None = None,
    min_points: int = 30,
    fmt: str = "parquet",
    schema: T.StructType = BAR_SCHEMA,
    key: str = "key",
) -> DataFrame:
    """OHLCV history of the wanted keys that have at least ``min_points`` rows."""
    options = {"header": "true"} if fmt == "csv" else {}
    df = read_table(spark, path, fmt, schema, **options)
    if symbols is not None:
        df = df.filter(F.col(key).isin(list(symbols)))
    return enough_points(df, key, min_points)


def enough_points(df: DataFrame, key: str = "key", min_points: int = 30) -> DataFrame:
    """Keep keys with at least ``min_points`` rows (short keys are the error case upstream).

    The short keys form the small side, so a hot key's rows stay where they were read unless
    the planner measures that side as too large to broadcast.
    """
    short = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_points)
    return df.join(short, key, "left_anti")


def point_counts(df: DataFrame, key: str = "key", min_points: int = 30) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("enough", F.col("n_rows") >= min_points)
    )


def date_range(
    df: DataFrame, end: str, start: str | None = None, lookback_days: int = 365, ds: str = "ds"
) -> DataFrame:
    """Rows with start <= ds < end; ``start`` defaults to ``end - lookback_days``."""
    import pandas as pd

    stop = pd.Timestamp(end)
    begin = pd.Timestamp(start) if start else stop - pd.Timedelta(days=lookback_days)
    if begin >= stop:
        raise ValueError("start must lie before end")
    lo, hi = F.lit(begin.isoformat(sep=" ")), F.lit(stop.isoformat(sep=" "))
    kind = df.schema[ds].dataType.simpleString()
    return df.filter((F.col(ds) >= lo.cast(kind)) & (F.col(ds) < hi.cast(kind)))


def time_span(df: DataFrame, ds: str) -> tuple[str, str]:
    """First day of a time column and the day after its last one, from one narrow aggregation."""
    low, high = df.agg(
        *[F.date_format(f(F.col(ds).cast("timestamp_ntz")), "yyyy-MM-dd") for f in (F.min, F.max)]
    ).first()
    if low is None:
        return "1970-01-01", "1970-01-02"  # no rows
    return low, str(datetime.date.fromisoformat(high) + datetime.timedelta(days=1))


def make_bars(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    interval: str = "1d",
    key: str = "key",
    ts: str = "ts",
    price: str = "price",
    volume: Column | str | None = None,
    tie: Sequence[str] = (),
) -> Series:
    """OHLCV bars of raw ticks in [start, end): one partial aggregation, so hot keys combine map-side.

    Without a range all rows count, and a look at the time column gives their span. The result has
    at most one row per key and slot of the span; that bound is recorded on the series.
    """
    if start is None or end is None:
        low, high = time_span(df, ts)
        start, end = start or low, end or high
    size = 0.0 if volume is None else volume
    size = F.lit(size) if isinstance(size, float) else (F.col(size) if isinstance(size, str) else size)
    at = F.struct(ts, *tie)
    bars = (
        normalise(date_range(df, end, start, ds=ts))
        .groupBy(F.col(key).alias("key"), bar_start(F.col(ts), interval).alias("ds"))
        .agg(
            F.min_by(price, at).alias("Open"),
            F.max(price).alias("High"),
            F.min(price).alias("Low"),
            F.max_by(price, at).alias("Close"),
            F.sum(size.cast("double")).alias("Volume"),
        )
    )
    # The first slot may begin before the range.
    return series(bars, y="Close", max_rows=slots(start, end, interval_seconds(interval)) + 1)


def resample_bars(
    s: Series, interval: str, start: str | None = None, end: str | None = None
) -> Series:
    """Coarser bars from finer bars; the range bounds the rows of a key and filters nothing.

    Without a range the finer bars' bound holds: coarser bars are not more.
    """
    at = F.struct(*s.order)
    bars = s.df.groupBy(*s.keys, bar_start(F.col(s.ds), interval).alias("_slot")).agg(
        F.min_by("Open", at).alias("Open"),
        F.max("High").alias("High"),
        F.min("Low").alias("Low"),
        F.max_by("Close", at).alias("Close"),
        F.sum("Volume").alias("Volume"),
    )
    bars = bars.withColumnRenamed("_slot", s.ds)
    known = slots(start, end, interval_seconds(interval)) + 1 if start and end else s.max_rows
    return s.reordered(bars, s.ds, max_rows=known)


def daily(
    df: DataFrame, key: Column, ds: str, y: Column, start: str | None = None,
    end: str | None = None, **extra: Column,
) -> Series:
    """Aggregate a fact table to one row per key and day in [start, end): y plus any extras.

    Without a range all rows count, and a look at the time column gives their span.

    The range filters the stored column before any cast, so it reaches the scan; the
    aggregation combines map-side, so a hot key sends one row per day and task.
    """
    if start is None or end is None:
        low, high = time_span(df, ds)
        start, end = start or low, end or high
    rows = normalise(date_range(df, end, start, ds=ds))
    rows = rows.groupBy(key.cast("string").alias("key"), F.date_trunc("day", ds).alias("ds")).agg(
        y.alias("y"), *[c.alias(n) for n, c in extra.items()]
    )
    return series(rows, max_rows=slots(start, end, 86400))


def to_series(df: DataFrame, ts: str, target: str = "Adj Close", key: str = "key") -> DataFrame:
    """Rename the time and target columns to ds and y; fall back through the known names."""
    found = next((c for c in (target, *TARGET_FALLBACKS) if c in df.columns), None)
    if found is None:
        raise ValueError(f"no target column: tried {(target, *TARGET_FALLBACKS)}")
    return df.select(
        *[
            F.col(f"`{c}`").alias({ts: "ds", found: "y"}.get(c, c))
            for c in df.columns
            if c == ts or c == found or c not in ("ds", "y")
        ]
    )


def missing_targets(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y").isNull()).alias("n_missing")
    )


def target_to_close(df: DataFrame) -> DataFrame:
    """Make the cleaned target the closing price the indicators read."""
    return df.withColumn("Close", F.col("y"))


def load_csv(
    spark: SparkSession, path: str, ds: str = "ds", y: str = "y", key: str | None = None,
    date_format: str | None = None,
) -> DataFrame:
    """CSV with a header; dates that do not parse become NULL instead of failing the load."""
    names = [c for c in (key, ds, y) if c]
    header = spark.read.option("header", "true").csv(path)
    absent = [c for c in names if c not in header.columns]
    if absent:
        raise ValueError(f"CSV lacks columns {absent}")
    form = [F.lit(date_format)] if date_format else []
    return normalise(
        header.select(
            *([F.col(key).alias("key")] if key else []),
            F.try_to_timestamp(F.col(ds), *form).alias("ds"),
            F.expr(f"try_cast(`{y}` AS DOUBLE)").alias("y"),
        )
    )


def load_checks(
    df: DataFrame, keys: Sequence[str] = ("key",), min_points: int = 30, max_range: float = 1e6
) -> DataFrame:
    """Checks that a loaded file gets: rows, unparsed dates, missing targets, value range."""
    spread = F.max("y") - F.min("y")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("ds").isNull()).alias("bad_dates"),
        F.count_if(F.col("y").isNull()).alias("missing_y"),
        (F.count(F.lit(1)) < min_points).alias("too_few"),
        (spread > max_range).alias("wide_range"),
    )


def load_json(
    spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False
) -> DataFrame:
    return read_table(spark, path, "json", schema, multiLine=str(multiline).lower())


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Distributed CSV sink with headers; one folder per partition value."""
    writer = df.write.mode("overwrite").option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path

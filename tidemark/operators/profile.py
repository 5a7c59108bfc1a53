"""Data quality: profiles, validation and correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_infinite
from tidemark.operators.quantiles import quantiles
from tidemark.plans.segments import planned, windowed
from tidemark.plans.series import Series, numeric_columns


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys)


def null_profile(
    df: DataFrame, keys: Sequence[str] = (), threshold: float = 0.2
) -> DataFrame:
    """NULL count and share of every column; one pass over the table."""
    cols = [c for c in df.columns if c not in keys]
    wide = _grouped(df, keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]
    )
    long = wide.unpivot([*keys, "_rows"], cols, "column", "nulls")
    share = F.try_divide(F.col("nulls").cast("double"), F.col("_rows"))
    return long.select(
        *keys, "column", "nulls", share.alias("null_share"), (share > threshold).alias("is_issue")
    )


def infinity_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = numeric_columns(df, exclude=keys)
    wide = _grouped(df, keys).agg(
        *[F.count_if(is_infinite(F.col(c).cast("double"))).alias(c) for c in cols]
    )
    return wide.unpivot(list(keys), cols, "column", "infinities")


def value_profile(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    min_unique_ratio: float = 0.01,
    max_constant_share: float = 0.95,
) -> DataFrame:
    """Distinct values, their ratio to all rows, and the share of the most frequent value.

    Both come from one count per (column, value). That count combines map-side, so a value
    that fills most of a column sends one row per task.
    """
    cols = list(cols or numeric_columns(df, exclude=keys))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    )
    counts = df.select(*keys, pairs.alias("_p")).groupBy(*keys, "_p.column", "_p.v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = F.when(F.col("v").isNotNull(), F.col("_n"))
    out = counts.groupBy(*keys, "column").agg(
        F.sum("_n").alias("n_rows"),
        F.count(known).alias("n_unique"),
        F.max(known).alias("_top"),
        F.sum(known).alias("_known"),
    )
    ratio = F.try_divide(F.col("n_unique").cast("double"), F.col("n_rows"))
    top = F.try_divide(F.col("_top").cast("double"), F.col("_known"))
    return out.select(
        *keys, "column", "n_rows", "n_unique",
        ratio.alias("unique_ratio"), (ratio < min_unique_ratio).alias("low_variance"),
        top.alias("top_share"), F.coalesce(top > max_constant_share, F.lit(False)).alias("near_constant"),
    )


def approximate_unique(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Opt-in sketch version of the distinct counts: one pass, no shuffle of values."""
    wide = _grouped(df, keys).agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    return wide.unpivot(list(keys), list(cols), "column", "n_unique")


def target_shape(
    df: DataFrame, y: str = "y", keys: Sequence[str] = ("key",), max_skew: float = 3.0,
    max_kurtosis: float = 10.0,
) -> DataFrame:
    """Population skewness and excess kurtosis of the target, with flags."""
    out = _grouped(df, keys).agg(F.skewness(y).alias("skew"), F.kurtosis(y).alias("kurt"))
    return out.withColumns(
        {
            "highly_skewed": F.coalesce(F.abs("skew") > max_skew, F.lit(False)),
            "extreme_kurtosis": F.coalesce(F.abs("kurt") > max_kurtosis, F.lit(False)),
        }
    )


def gaps(s: Series) -> DataFrame:
    """Microseconds since the previous row of the key."""
    now = F.unix_micros(F.col(s.ds).cast("timestamp"))
    return windowed(s, 1, lambda w: {"gap": now - F.lag(now).over(w)})


def disorder(s: Series, arrival: str) -> DataFrame:
    """Rows of each key that are older than the row that arrived just before them."""
    by_arrival = s.reordered(s.df, arrival, max_rows=s.max_rows)
    df = windowed(by_arrival, 1, lambda w: {"_late": F.col(s.ds) < F.lag(s.ds).over(w)})
    return df.groupBy(*s.keys).agg(F.count_if("_late").alias("n_disordered"))


def validate_series(
    s: Series,
    as_of: Column | None = None,
    gap_factor: float = 5.0,
    min_days: int = 7,
    arrival: str | None = None,
) -> DataFrame:
    """Per-key checks: duplicates, negatives, large gaps, future stamps, short range, order."""
    s = planned(s)
    keys = list(s.keys)
    future = F.count_if(F.col(s.ds) > as_of) if as_of is not None else F.lit(0).cast("long")
    basic = s.df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(s.ds) - F.count_distinct(s.ds)).alias("n_duplicates"),
        F.count_if(F.col(s.y) < 0).alias("n_negative"),
        future.alias("n_future"),
        F.timestamp_diff("DAY", F.min(s.ds), F.max(s.ds)).alias("range_days"),
    )
    stepped = s.on(gaps(s))
    steps = quantiles(stepped, {"median_gap": ("gap", 0.5)}).join(
        stepped.df.groupBy(*keys).agg(F.max("gap").alias("max_gap")), keys
    )
    out = basic.join(steps, keys, "left")
    if arrival is not None:
        out = out.join(disorder(s, arrival), keys, "left")
    return out.withColumns(
        {
            "large_gap": F.coalesce(F.col("max_gap") > F.col("median_gap") * gap_factor, F.lit(False)),
            "short_range": F.col("range_days") < min_days,
        }
    )


def dtype_issues(df: DataFrame, ds: str = "ds", y: str = "y", required: Sequence[str] = ()) -> list[str]:
    """Schema checks, which need no data: missing columns and wrong types."""
    kinds = dict(df.dtypes)
    issues = [f"missing column {c}" for c in (ds, y, *required) if c not in kinds]
    if ds in kinds and not kinds[ds].startswith(("timestamp", "date")):
        issues.append(f"column {ds} is not a date or timestamp")
    if y in kinds and y not in numeric_columns(df):
        issues.append(f"column {y} is not numeric")
    return issues


def validate_model_frame(
    s: Series, min_rows: int = 100, max_missing: float = 0.1, min_unique_ratio: float = 0.01
) -> DataFrame:
    """Per key and column: enough rows, NULL share, distinct ratio."""
    keys = list(s.keys)
    cols = numeric_columns(s.df, exclude=keys)
    nulls = null_profile(s.df.select(*keys, *cols), keys, max_missing).withColumnRenamed("is_issue", "too_many_nulls")
    values = value_profile(s.df, cols, keys, min_unique_ratio).select(
        *keys, "column", "n_rows", "unique_ratio", "low_variance"
    )
    return nulls.join(values, [*keys, "column"]).withColumn("too_few_rows", F.col("n_rows") < min_rows)


def validate_bars(s: Series, min_rows: int = 100, max_missing: float = 0.1) -> DataFrame:
    """Per key: row count, order and the NULL share of every price column."""
    bars = [c for c in ("Open", "High", "Low", "Close", "Volume") if c in s.df.columns]
    if "Close" not in bars:
        raise ValueError("bars need a Close column")
    share = {
        f"null_share_{c.lower()}": F.avg(F.col(c).isNull().cast("double")) for c in bars
    }
    out = s.df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(s.ds) - F.count_distinct(s.ds)).alias("n_duplicates"),
        *[c.alias(n) for n, c in share.items()],
    )
    worst = F.greatest(*[F.col(n) for n in share], F.lit(0.0))
    return out.withColumns(
        {"too_few": F.col("n_rows") < min_rows, "too_many_nulls": worst > max_missing}
    )


def feature_quality(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """NULL share, infinities and constancy of many features in one aggregation."""
    stats = []
    for c in features:
        x = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(x.isNull().cast("double")).alias("null_share"),
                F.count_if(is_infinite(x)).alias("infinities"),
                F.coalesce(F.min(x) == F.max(x), F.lit(False)).alias("is_constant"),
            )
        )
    return _grouped(df, keys).agg(F.array(*stats).alias("_s")).select(*keys, F.inline("_s"))


def correlation_pairs(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of every column pair (i < j); NULL where a column is constant.

    All pairs come from one partial aggregation over co-moments.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]

    def joint(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        return F.struct(
            F.lit(a).alias("col_a"),
            F.lit(b).alias("col_b"),
            F.covar_pop(x, y).alias("cov"),
            (F.stddev_pop(x) * F.stddev_pop(y)).alias("scale"),
        )

    wide = _grouped(df, keys).agg(F.array(*[joint(a, b) for a, b in pairs]).alias("_p"))
    long = wide.select(*keys, F.inline("_p"))
    return long.select(*keys, "col_a", "col_b", F.try_divide("cov", "scale").alias("r"))


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Correlation of all column pairs, each over the rows where both are known; NaN if constant.

    Each task adds up its Arrow batches and sends four matrices of columns squared entries, which
    the JVM adds up. Values are taken from a column's mean, so a large mean costs no digits.
    """
    k = len(cols)
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    narrow = narrow.select(*[F.when(~is_infinite(F.col(c)) & ~F.isnan(c), F.col(c)).alias(c) for c in cols])
    middle = np.array([m or 0.0 for m in narrow.agg(*[F.avg(c) for c in cols]).first()])

    def partial(batches):
        total = np.zeros((4, k, k))
        for b in batches:
            x = b.to_numpy(dtype=float) - middle
            known = np.isfinite(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        yield pd.DataFrame({"products": [total.ravel()]})

    parts = narrow.mapInPandas(partial, "products array<double>")
    summed = parts.select(Summarizer.sum(array_to_vector("products")).alias("s")).first()
    if summed["s"] is None or not summed["s"].size:
        return np.full((k, k), np.nan)
    n, total, squares, products = summed["s"].toArray().reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = total / n  # of column i over the rows where j is known too
        var = squares / n - mean * mean
        # Below this share of the mean square a variance is rounding noise of a constant column.
        var[var <= 1e-13 * (squares / n + middle[:, None] ** 2 * 1e-13)] = np.nan
        return (products / n - mean * mean.T) / np.sqrt(var * var.T)


def correlated_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns that correlate with any earlier column beyond the threshold, over all keys."""
    if len(cols) < 2:
        return []
    r = np.abs(pairwise_correlations(df, cols))
    return [c for j, c in enumerate(cols) if np.nanmax(r[:j, j], initial=0.0) > threshold]


def decorrelate(
    s: Series, threshold: float = 0.95, preserve: Sequence[str] = ("ds", "y")
) -> tuple[Series, list[str]]:
    """Drop every column that duplicates an earlier one; one drop list for all keys."""
    cols = numeric_columns(s.df, exclude=(*preserve, s.ds, s.y, *s.keys, *s.seq))
    drop = correlated_columns(s.df, cols, threshold)
    return s.on(s.df.drop(*drop)), drop


def summary_stats(s: Series) -> DataFrame:
    keys = list(s.keys)
    return (
        s.df.groupBy(*keys)
        .agg(F.avg(s.y).alias("mean"), F.count(s.y).alias("n"))
        .join(quantiles(s, {"median": (s.y, 0.5)}), keys)
    )

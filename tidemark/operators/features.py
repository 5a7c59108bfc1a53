"""Model features: lags, rolling statistics, calendar, scaling and the chronological split."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tidemark.functions.calendar import add_calendar
from tidemark.operators.profile import decorrelate
from tidemark.plans.segments import HOME, attach, fill, numbered, planned, segment, settle, windowed, with_stats
from tidemark.plans.series import Series, numeric_columns, strip_tz, whole_keys
from tidemark.session import settled, settled_in_place

# The lags, windows and statistics that make the feature names.
LAGS = (1, 7, 14, 30)
WINDOWS = (7, 14, 30)
STATISTICS = ("mean", "std", "min", "max", "skew", "kurt")


def whole_rows(df: DataFrame) -> DataFrame:
    """Rows without a NULL or NaN.

    By a count: the plain form leaves a NOT NULL constraint per column, which the optimizer carries
    through every alias of the windows above, until planning takes minutes.
    """
    return df.na.drop(thresh=len(df.columns))


def add_lags(
    s: Series, lags: Sequence[int] = LAGS, col: str | None = None, drop_rows: bool = True
) -> Series:
    """``{col}_lag_{n}``; then rows with any NULL in any column go, as the warm-up rows do."""
    col = col or s.y
    df = windowed(s, max(lags), lambda w: {f"{col}_lag_{n}": F.lag(col, n).over(w) for n in lags})
    return s.filtered(whole_rows(df)) if drop_rows else s.on(df)


def _statistic(w: WindowSpec, y: Column, n: int, kind: str) -> Column:
    f = w.rowsBetween(1 - n, 0)
    if kind == "mean":
        return F.avg(y).over(f)
    if kind == "std":
        return F.stddev_samp(y).over(f)
    if kind == "min":
        return F.min(y).over(f)
    if kind == "max":
        return F.max(y).over(f)
    m = F.count(y).over(f).cast("double")
    if kind == "skew":
        # The bias-corrected form; a constant window has skew 0 once three rows are there.
        value = F.skewness(y).over(f) * F.sqrt(m * (m - 1)) / (m - 2)
        return F.when(m >= 3, F.coalesce(value, F.lit(0.0)))
    if kind == "kurt":
        excess = F.kurtosis(y).over(f)
        value = ((m + 1) * excess + 6) * (m - 1) / ((m - 2) * (m - 3))
        return F.when(m >= 4, F.coalesce(value, F.lit(-3.0)))
    raise ValueError(f"unknown statistic {kind!r}; one of {STATISTICS}")


FRAME_VALUES = 1_000_000  # values of the frames that are held together
WHOLE_ROWS = 50_000  # rows of whole keys that are held together; a longer key makes more


def rolling_arrays(x: np.ndarray, known: np.ndarray, place: np.ndarray, n: int, kinds: Sequence[str]) -> dict:
    """Statistics of the last n rows of each row but the first n - 1: kind -> (values, where NULL).

    ``place`` is a row's number within its key from 1, so frames end where the key begins. Moments
    are taken from the frame's own mean; a constant frame has none beyond it.
    """
    # A frame is a column: sums over the frames' places go along the rows, many frames at a time.
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, n).T)
    inside = np.arange(n - 1, -1, -1)[:, None] < place[None, n - 1 :]
    here = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(known, n).T) & inside
    m = here.sum(axis=0).astype(float)
    low = np.fmin.reduce(np.where(here, wide, np.nan), axis=0)
    high = np.where(here, wide, -np.inf).max(axis=0)  # NaN is the largest value
    with np.errstate(all="ignore"):
        mean = np.where(here, wide, 0.0).sum(axis=0) / m
        d = np.where(here, wide - mean, 0.0)
        d[:, low == high] = 0.0
        d2 = d * d
        m2 = d2.sum(axis=0)
        flat = m2 == 0
        out = {
            "mean": (mean, m == 0), "std": (np.sqrt(m2 / (m - 1)), m < 2),
            "min": (low, m == 0), "max": (high, m == 0),
        }
        if "skew" in kinds:
            value = np.sqrt(m) * (d2 * d).sum(axis=0) / np.sqrt(m2 * m2 * m2) * np.sqrt(m * (m - 1)) / (m - 2)
            out["skew"] = (np.where(flat, 0.0, value), m < 3)
        if "kurt" in kinds:
            value = ((m + 1) * (m * (d2 * d2).sum(axis=0) / (m2 * m2) - 3) + 6) * (m - 1) / ((m - 2) * (m - 3))
            out["kurt"] = (np.where(flat, -3.0, value), m < 4)
    return {k: out[k] for k in kinds}


def _rolling_frames(s: Series, windows: Sequence[int], statistics: Sequence[str], col: str) -> DataFrame:
    """Rolling statistics of a double column, by Arrow batches in the order of the window.

    A window function adds up every frame anew, row by row. Here the rows of a task stream past in
    that same order, and frames of a batch are one strided array; a batch starts with the last rows
    of the one before.
    """
    for kind in statistics:
        if kind not in STATISTICS:
            raise ValueError(f"unknown statistic {kind!r}; one of {STATISTICS}")
    most, out = max(windows), {f"rolling_{k}_{n}": (k, n) for n in windows for k in statistics}
    seg = segment(s, most)
    kept = [f for f in s.df.schema.fields if f.name not in out]
    # Only a row's own columns go to Python, and copied rows do not come back. Sorting by the number of the
    # segment first tells most rows apart by their sort prefix.
    window = Window.partitionBy(*reversed(seg.part)).orderBy(*s.order)
    home = [HOME] if seg.split else []
    passed = dict.fromkeys([*[f.name for f in kept], col, *home, "_place"])
    df = seg.df.withColumn("_place", F.row_number().over(window)).select(*passed)
    rows_at_once = max(1, FRAME_VALUES // most)

    def frames(batches):
        x, known, place = np.zeros(most - 1), np.zeros(most - 1, bool), np.zeros(most - 1, np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(a, rows_at_once)
                y = batch.column(col)
                x = np.concatenate([x, y.fill_null(0.0).to_numpy(zero_copy_only=False)])
                known = np.concatenate([known, y.is_valid().to_numpy(zero_copy_only=False)])
                place = np.concatenate([place, batch.column("_place").to_numpy(zero_copy_only=False)])
                if not ((place[most - 1 :] == 1) | (place[most - 1 :] == place[most - 2 : -1] + 1) | (most == 1)).all():
                    raise ValueError("rows do not come in the order of their window")
                found = {}
                for n in windows:
                    part = slice(most - n, None)
                    for k, v in rolling_arrays(x[part], known[part], place[part], n, statistics).items():
                        found[k, n] = pa.array(v[0], mask=v[1])
                columns = {f.name: batch.column(f.name) for f in kept}
                done = pa.RecordBatch.from_pydict(columns | {name: found[at] for name, at in out.items()})
                yield done.filter(batch.column(HOME)) if home else done
                keep = len(x) - (most - 1)
                x, known, place = x[keep:], known[keep:], place[keep:]

    schema = T.StructType([*kept, *[T.StructField(name, T.DoubleType()) for name in out]])
    return df.mapInArrow(frames, schema)


def rolling_columns(
    s: Series, windows: Sequence[int] = WINDOWS, statistics: Sequence[str] = STATISTICS,
    col: str | None = None,
) -> Series:
    """``rolling_{statistic}_{n}`` over the last n rows with the current one, as available."""
    if isinstance(s.df.schema[col or s.y].dataType, T.DoubleType):
        return s.on(_rolling_frames(s, windows, statistics, col or s.y))
    y = F.col(col or s.y)
    df = windowed(
        s,
        max(windows),
        lambda w: {f"rolling_{k}_{n}": _statistic(w, y, n, k) for n in windows for k in statistics},
    )
    return s.on(df)


def add_rolling(
    s: Series, windows: Sequence[int] = WINDOWS, statistics: Sequence[str] = STATISTICS,
    col: str | None = None,
) -> Series:
    """Rolling statistics without gaps: the next value, else the key's global statistic or 0."""
    s = planned(s)
    col = col or s.y
    names = {f"rolling_{k}_{n}": k for n in windows for k in statistics}
    whole = {"mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col)}
    used = {f"_g_{k}": whole[k] for k in statistics if k in whole}
    if s.bounded and isinstance(s.df.schema[col].dataType, T.DoubleType):
        df = with_stats(s, used) if used else s.df
        return s.on(_filled_frames(s.on(df), windows, statistics, col))
    out = rolling_columns(s, windows, statistics, col)
    out = s.on(fill(settle(out), {n: F.col(n) for n in names}, forward=False))
    df = with_stats(out, used) if used else out.df
    rest = {n: F.coalesce(n, f"_g_{k}") if k in whole else F.coalesce(n, F.lit(0.0)) for n, k in names.items()}
    return s.on(df.withColumns(rest).drop(*used))


def _filled_frames(s: Series, windows: Sequence[int], statistics: Sequence[str], col: str) -> DataFrame:
    """Rolling statistics of bounded series without gaps, in one pass of whole keys.

    Rows come with the statistics of their key (``_g_{kind}``, not kept). The next value is looked up
    where the frames are made, as rows that come out of Python would be moved to their key again for it.
    """
    for kind in statistics:
        if kind not in STATISTICS:
            raise ValueError(f"unknown statistic {kind!r}; one of {STATISTICS}")
    out = {f"rolling_{k}_{n}": (k, n) for n in windows for k in statistics}
    kept = [f for f in s.df.schema.fields if f.name not in out and f.name not in {f"_g_{k}" for k in statistics}]
    window = Window.partitionBy(*s.keys).orderBy(*s.order)
    rows = s.df.withColumn("_place", F.row_number().over(window))
    most = max(windows)
    rows_at_once = max(1, FRAME_VALUES // most)

    def rolled(x, known, place):
        """Statistics of whole keys: name -> (values, where NULL)."""
        edge = most - 1
        x, known, place = (np.concatenate([np.zeros(edge, v.dtype), v]) for v in (x, known, place))
        parts = []
        for a in range(0, len(x) - edge, rows_at_once):
            found = {}
            for n in windows:
                part = slice(a + most - n, a + rows_at_once + edge)
                found |= {f"rolling_{k}_{n}": v for k, v in rolling_arrays(x[part], known[part], place[part], n, statistics).items()}
            parts.append(found)
        return {name: tuple(np.concatenate([p[name][i] for p in parts]) for i in (0, 1)) for name in out}

    def frames(batches):
        for table in whole_keys(batches, WHOLE_ROWS):
            y, place = table.column(col), table.column("_place").to_numpy().astype(np.int64)
            if not ((place == 1) | (place == np.append(0, place[:-1]) + 1)).all():
                raise ValueError("rows do not come in the order of their window")
            found = rolled(y.fill_null(0.0).to_numpy(), y.is_valid().to_numpy(), place)
            rows, key = np.arange(len(place)), np.cumsum(place == 1)
            for name, (kind, _) in out.items():
                value, gap = found[name]
                if gap.any():
                    after = np.minimum.accumulate(np.where(gap, len(rows), rows)[::-1])[::-1]
                    there = np.minimum(after, len(rows) - 1)
                    value, gap = value[there], (after == len(rows)) | (key[there] != key)
                if gap.any():
                    rest = table.column(f"_g_{kind}") if f"_g_{kind}" in table.column_names else pa.array(np.zeros(len(rows)))
                    value = np.where(gap, rest.fill_null(0.0).to_numpy(), value)
                    gap = gap & ~rest.is_valid().to_numpy(zero_copy_only=False)
                found[name] = pa.array(value, mask=gap)
            done = table.select([f.name for f in kept])
            for name in out:
                done = done.append_column(name, found[name])
            yield from done.to_batches()

    schema = T.StructType([*kept, *[T.StructField(name, T.DoubleType()) for name in out]])
    return rows.mapInArrow(frames, schema)


def standardize(
    s: Series, cols: Sequence[str] | None = None, fit_on: str = "all"
) -> Series:
    """(x - mean) / population deviation per key; a constant column only loses its mean.

    ``fit_on='train'`` takes both from the rows marked ``is_train``.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    cols = list(cols or numeric_columns(s.df, exclude=(s.y, s.ds, *s.keys, *s.seq)))

    def used(c: str) -> Column:
        x = F.col(c).cast("double")
        return x if fit_on == "all" else F.when(F.col("is_train"), x)

    stats = {f"_m_{c}": F.avg(used(c)) for c in cols} | {f"_s_{c}": F.stddev_pop(used(c)) for c in cols}
    df = with_stats(s, stats)
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in cols
    }
    return s.on(df.withColumns(scaled).drop(*stats))


def split_train_test(s: Series, ratio: float = 0.2) -> Series:
    """``is_train`` marks the first ``int(n * (1 - ratio))`` rows of each key in time order."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    s = planned(s)
    df = numbered(s, "_rn")
    df = with_stats(s.on(df), {"_n": F.count(F.lit(1))})
    first = F.floor(F.col("_n") * F.lit(1 - ratio))
    return s.on(df.withColumn("is_train", F.col("_rn") <= first).drop("_rn", "_n"))


def invalid_splits(s: Series, ratio: float = 0.2) -> DataFrame:
    """Keys too short to give both a train and a test row."""
    n = F.count(F.lit(1))
    cut = F.floor(F.col("n_rows") * F.lit(1 - ratio))
    return s.df.groupBy(*s.keys).agg(n.alias("n_rows")).filter((cut <= 0) | (cut >= F.col("n_rows")))


def growth_bounds(s: Series) -> DataFrame:
    """Floor 0 and cap ``max + 2 * sample deviation`` of the target, per key."""
    return s.df.groupBy(*s.keys).agg(
        F.lit(0.0).alias("floor"), (F.max(s.y) + 2 * F.stddev_samp(s.y)).alias("cap")
    )


def regressor_features(s: Series) -> DataFrame:
    """Date parts in front of all other columns, for the tree models."""
    d = F.col(s.ds)
    parts = {
        "year": F.year(d), "month": F.month(d), "day": F.day(d),
        "dayofweek": F.weekday(d), "quarter": F.quarter(d),
    }
    rest = [c for c in s.df.columns if c not in parts]
    return s.df.select(*rest, *[c.alias(n) for n, c in parts.items()])


def prepare(
    s: Series, ratio: float = 0.2, threshold: float = 0.95, fit_on: str = "all",
    drop_rows: bool = True,
) -> tuple[Series, list[str]]:
    """Lags, rolling, calendar, decorrelation, scaling and the split; also the dropped columns.

    Lags drop their warm-up rows before the rolling statistics start. The drop list is the only
    thing that reaches the driver; the split precedes scaling so that ``fit_on='train'`` works.
    """
    out = add_rolling(add_lags(planned(s)))
    # Decorrelation reads the features twice and the split and scaling again: written once. Rows of bounded
    # series come with their key and stay with it, so that what follows need not move them.
    df = add_calendar(out.df, out.ds)
    out = out.on(settled_in_place(df, out.keys) if out.bounded else settled(df))
    out, dropped = decorrelate(out, threshold, preserve=(s.ds, s.y))
    out = split_train_test(out.filtered(whole_rows(out.df)) if drop_rows else out, ratio)
    out = standardize(out, fit_on=fit_on)
    return out.on(strip_tz(out.df, out.ds)), dropped

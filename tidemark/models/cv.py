"""Future frames, rolling-origin cutoffs, folds and parameter grids."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_duration
from tidemark.plans.segments import attach, windowed
from tidemark.plans.series import Series

# The two default search grids.
TUNER_GRID = {
    "changepoint_prior_scale": (0.001, 0.01, 0.1, 0.5),
    "seasonality_prior_scale": (0.01, 0.1, 1.0, 10.0),
    "holidays_prior_scale": (0.01, 0.1, 1.0, 10.0),
    "seasonality_mode": ("additive", "multiplicative"),
    "changepoint_range": (0.8, 0.85, 0.9, 0.95),
}
TRAINER_GRID = {
    "changepoint_prior_scale": (0.001, 0.01, 0.1, 0.5),
    "seasonality_prior_scale": (0.01, 0.1, 1.0, 10.0),
    "holidays_prior_scale": (0.01, 0.1, 1.0, 10.0),
    "seasonality_mode": ("multiplicative",),
}


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Every combination of the grid's values, numbered; sized by the grid alone."""
    grid = dict(TUNER_GRID if grid is None else grid)
    names = list(grid)
    rows = [(i, *combo) for i, combo in enumerate(itertools.product(*grid.values()))]
    kinds = ["string" if isinstance(grid[n][0], str) else "double" for n in names]
    schema = "param_id int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    typed = [
        (i, *[float(v) if k == "double" else v for v, k in zip(combo, kinds)])
        for i, *combo in rows
    ]
    return spark.createDataFrame(typed, schema)


def future_frame(s: Series, periods: int, step: str = "1 day", include_history: bool = True) -> DataFrame:
    """The next ``periods`` steps after each key's last time, with the history in front."""
    step_col = F.expr(f"INTERVAL {step}")
    last = s.df.groupBy(*s.keys).agg(F.max(s.ds).alias("_last"))
    times = F.sequence(F.col("_last") + step_col, F.col("_last") + step_col * periods, step_col)
    future = last.select(*s.keys, F.explode(times).alias(s.ds), F.lit(True).alias("is_future"))
    if not include_history:
        return future
    return s.df.select(*s.keys, s.ds, F.lit(False).alias("is_future")).unionByName(future)


def carry_regressors(s: Series, future: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Future rows get each regressor's last known value of their key."""
    last = s.df.groupBy(*s.keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*s.order))).alias(c) for c in cols]
    )
    return future.join(last, list(s.keys), "left")


def _micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def cv_cutoffs(s: Series, initial: str, period: str, horizon: str) -> DataFrame:
    """Cutoffs per key: from ``last - horizon`` back in steps of ``period``, not before
    ``first + initial``.

    A cutoff with no row in the horizon after it moves to ``horizon`` before the last row at or
    before it, and the steps go on from there. Only gaps longer than the horizon can cause
    that, so the fold sees those gaps (at most span / horizon of them), not the rows.
    """
    i, p, h = (parse_duration(x) * 1_000_000 for x in (initial, period, horizon))
    return _cutoffs(s, F.lit(i), F.lit(p), F.lit(h), None)


def data_driven_cutoffs(s: Series) -> DataFrame:
    """Cutoffs whose sizes follow the row count n of daily data:
    horizon max(min(n/5, 30), 7), initial max(n/2, 3 horizons), period max(horizon/10, 1)."""
    day = F.lit(86_400_000_000)
    sizes = s.df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_rows"))
    h = F.greatest(F.least(F.floor(F.col("_rows") / 5), F.lit(30)), F.lit(7))
    sizes = sizes.withColumn("_h", h)
    sizes = sizes.select(
        *s.keys,
        (F.col("_h") * day).alias("_h"),
        (F.greatest(F.floor(F.col("_rows") / 2), 3 * F.col("_h")) * day).alias("_i"),
        (F.greatest(F.floor(F.col("_h") / 10), F.lit(1)) * day).alias("_p"),
    )
    return _cutoffs(s, F.col("_i"), F.col("_p"), F.col("_h"), sizes)


def _cutoffs(s: Series, i: Column, p: Column, h: Column, sizes: DataFrame | None) -> DataFrame:
    keys = list(s.keys)
    t = _micros(s.ds)
    stepped = windowed(s, 1, lambda w: {"_prev": F.lag(t).over(w)}).withColumn("_t", t)
    if sizes is not None:
        stepped = attach(s.on(stepped), sizes)
    gap = F.when(F.col("_t") - F.col("_prev") > h, F.struct(F.col("_prev").alias("a"), F.col("_t").alias("b")))
    aggs = [F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.collect_list(gap).alias("_gaps")]
    if sizes is not None:
        aggs += [F.first(c).alias(c) for c in ("_i", "_p", "_h")]
    ends = stepped.groupBy(*keys).agg(*aggs)
    first = F.col("_hi") - h
    floor = F.col("_lo") + i
    steps = F.greatest(F.floor((first - floor) / p), F.lit(0)).cast("int")

    def step(acc, _):
        now = acc["now"] - p
        hole = F.get(F.filter("_gaps", lambda g: (g["a"] <= now) & (g["b"] > now + h)), F.lit(0))
        jumped = F.when(hole.isNotNull() & (now > F.col("_lo")), hole["a"] - h).otherwise(now)
        out = F.when(jumped >= floor, F.array_append(acc["out"], jumped)).otherwise(acc["out"])
        return F.struct(jumped.alias("now"), out.alias("out"))

    start = F.struct(first.alias("now"), F.array(first).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda a: a["out"])
    found = ends.filter(first >= floor).select(
        *keys, F.explode(walked).alias("_c"), h.alias("horizon_us")
    )
    return found.filter(F.col("_c").isNotNull()).select(
        *keys, F.timestamp_micros("_c").alias("cutoff"), "horizon_us"
    )


def folds(s: Series, cutoffs: DataFrame) -> DataFrame:
    """Every row once per cutoff it trains (ds <= cutoff) or tests (within the horizon).

    The few cutoffs of a key join as one array, so a hot key's rows are never re-grouped.
    """
    keys = list(s.keys)
    lists = cutoffs.groupBy(*keys).agg(
        F.collect_list(F.struct("cutoff", "horizon_us")).alias("_cuts")
    )
    df = attach(s, lists)
    t = _micros(s.ds)
    used = F.filter("_cuts", lambda c: t <= F.unix_micros(c["cutoff"]) + c["horizon_us"])
    df = df.withColumn("_cut", F.explode(used)).drop("_cuts")
    return df.select(
        *s.df.columns,
        F.col("_cut.cutoff").alias("cutoff"),
        (F.col(s.ds) <= F.col("_cut.cutoff")).alias("is_train"),
    )


def backtest_cutoffs(s: Series, windows: int = 3, step: str = "30 days") -> DataFrame:
    """``windows`` cutoffs spaced ``step`` apart, each tested on the step after it."""
    us = parse_duration(step) * 1_000_000
    last = s.df.groupBy(*s.keys).agg(F.max(_micros(s.ds)).alias("_hi"))
    back = F.explode(F.sequence(F.lit(1), F.lit(windows)))
    return last.select(*s.keys, "_hi", back.alias("_k")).select(
        *s.keys,
        F.timestamp_micros(F.col("_hi") - F.col("_k") * us).alias("cutoff"),
        F.lit(us).alias("horizon_us"),
    )

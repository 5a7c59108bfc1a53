"""Forecast evaluation: joins with actuals, error metrics, strategies and drift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.segments import planned, running, settle, windowed
from tidemark.plans.series import Series


def with_actual(
    forecast: DataFrame, actual: DataFrame, keys: Sequence[str] = ("key",), ds: str = "ds", y: str = "y"
) -> DataFrame:
    """Inner join on key and time: the join key is nearly unique, so a hot key spreads."""
    return forecast.join(actual.select(*keys, ds, y), [*keys, ds], "inner")


METRICS = ("rmse", "mae", "mape")


def _metric(name: str, y: Column, yhat: Column) -> Column:
    e = y - yhat
    if name == "rmse":
        return F.sqrt(F.avg(e * e))
    if name == "mae":
        return F.avg(F.abs(e))
    if name == "mse":
        return F.avg(e * e)
    if name == "mape":
        return F.avg(F.try_divide(F.abs(e), y)) * 100
    if name == "mape_abs":
        return F.avg(F.abs(F.try_divide(e, y))) * 100
    raise ValueError(f"unknown metric {name!r}")


def evaluate_forecast(
    joined: DataFrame, metrics: Sequence[str] = METRICS, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """Chosen metrics per key. MAPE divides by the signed actual and skips zero actuals."""
    return joined.groupBy(*keys).agg(
        *[_metric(m, F.col("y"), F.col("yhat")).alias(m) for m in metrics]
    )


def evaluate_overall(
    joined: DataFrame, metrics: Sequence[str] = METRICS, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """Metrics per key and over all keys in one pass; the overall row has NULL keys."""
    keys = list(keys)
    sets = joined.groupingSets([[F.col(k) for k in keys], []], *keys)
    return sets.agg(*[_metric(m, F.col("y"), F.col("yhat")).alias(m) for m in metrics])


def evaluate_ensemble(joined: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """MAE, RMSE, MAPE of absolute ratios, and the share of actuals inside the interval."""
    inside = F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper"))
    y, yhat = F.col("y"), F.col("yhat")
    return joined.groupBy(*keys).agg(
        _metric("mae", y, yhat).alias("mae"),
        _metric("rmse", y, yhat).alias("rmse"),
        _metric("mape_abs", y, yhat).alias("mape"),
        (F.avg(inside.cast("double")) * 100).alias("coverage"),
    )


def last_rows(s: Series, n: int) -> DataFrame:
    """The last n rows of each key.

    A top-n by heap, not a full ranking: the planner keeps n rows per key and task before the
    shuffle (window group limit), so a hot key sends few rows.
    """
    w = Window.partitionBy(*s.keys).orderBy(*[F.col(c).desc() for c in s.order])
    return s.df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def split_history_future(
    forecast: DataFrame, history: DataFrame, keys: Sequence[str] = ("key",), ds: str = "ds"
) -> DataFrame:
    """``is_future`` marks rows after the last training time of their key."""
    last = history.groupBy(*keys).agg(F.max(ds).alias("_last"))
    out = forecast.join(last, list(keys), "left")
    return out.withColumn("is_future", F.coalesce(F.col(ds) > F.col("_last"), F.lit(True))).drop("_last")


def forecast_summary(future: Series, periods: int) -> DataFrame:
    """Mean, minimum, maximum and sample deviation of the last ``periods`` future rows."""
    tail = last_rows(future, periods)
    return tail.groupBy(*future.keys).agg(
        F.min(future.ds).alias("start"),
        F.max(future.ds).alias("end"),
        F.count(F.lit(1)).alias("periods"),
        F.avg("yhat").alias("mean"),
        F.min("yhat").alias("min"),
        F.max("yhat").alias("max"),
        F.stddev_samp("yhat").alias("std"),
    )


def error_by_period(joined: DataFrame, unit: str = "month", keys: Sequence[str] = ("key",), ds: str = "ds") -> DataFrame:
    e = F.col("y") - F.col("yhat")
    return joined.groupBy(*keys, F.date_trunc(unit, F.col(ds)).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")
    )


def rolling_error(s: Series, n: int = 30) -> DataFrame:
    """RMSE and MAE of the last n forecasts up to each row; ``s`` carries y and yhat."""
    e = F.col("y") - F.col("yhat")

    def cols(w):
        f = w.rowsBetween(1 - n, 0)
        return {
            "rolling_rmse": F.sqrt(F.avg(e * e).over(f)),
            "rolling_mae": F.avg(F.abs(e)).over(f),
        }

    return windowed(s, n, cols)


def directional_accuracy(s: Series) -> DataFrame:
    """Share of steps on which actual and forecast moved in the same direction."""
    df = windowed(
        s, 1,
        lambda w: {
            "_dy": F.signum(F.col("y") - F.lag("y").over(w)),
            "_df": F.signum(F.col("yhat") - F.lag("yhat").over(w)),
        },
    )
    return df.groupBy(*s.keys).agg(
        F.avg((F.col("_dy") == F.col("_df")).cast("double")).alias("directional_accuracy"),
        F.count("_dy").alias("n_steps"),
    )


def strategy_returns(s: Series) -> Series:
    """Hold the sign of the forecast move for one step: position, return and running equity."""
    last = lambda w: F.lag("y").over(w)
    s = planned(s)
    df = windowed(
        s, 1,
        lambda w: {
            "position": F.signum(F.col("yhat") - last(w)),
            "_ret": F.try_divide(F.col("y"), last(w)) - 1,
        },
    )
    df = df.withColumn("pnl", F.coalesce(F.col("position") * F.col("_ret"), F.lit(0.0))).drop("_ret")
    return s.on(running(settle(s.on(df)), sums={"equity": F.col("pnl")}))


def strategy_report(s: Series, periods_per_year: int = 252) -> DataFrame:
    """Total profit, Sharpe ratio and largest drawdown of the forecast-sign strategy."""
    held = strategy_returns(s)
    # The peak starts at 0, the equity before the first step.
    df = running(settle(held), maxima={"_peak": F.greatest("equity", F.lit(0.0))})
    return df.groupBy(*s.keys).agg(
        F.sum("pnl").alias("total_pnl"),
        (F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * F.sqrt(F.lit(float(periods_per_year)))).alias("sharpe"),
        F.max(F.col("_peak") - F.col("equity")).alias("max_drawdown"),
    )


def forecast_drift(joined: DataFrame, version: str = "version", keys: Sequence[str] = ("key",)) -> DataFrame:
    """Errors of stored forecasts by forecast version, with the bias that shows drift."""
    e = F.col("yhat") - F.col("y")
    return joined.groupBy(*keys, version).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("bias"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


# --- cross-validation metrics ---------------------------------------------------------------


def performance_metrics(
    cv: DataFrame, rolling_window: float = 0.1, keys: Sequence[str] = ("key",), median: bool = True
) -> DataFrame:
    """Metrics by horizon over a trailing window of all cross-validation rows.

    ``cv`` has ds, cutoff, y, yhat and, for coverage, the bounds. Rows are ordered by horizon;
    the metric at horizon h is the mean over the last ``w = floor(rolling_window * N)`` rows up
    to h, where the oldest horizon in the window counts pro rata. Everything after the first
    aggregation has one row per key and horizon. MAPE and MdAPE are NULL for a key with an
    actual near zero, where they mean nothing.
    """
    keys = list(keys)
    y, yhat = F.col("y"), F.col("yhat")
    err = y - yhat
    horizon = F.unix_micros(F.col("ds").cast("timestamp")) - F.unix_micros(F.col("cutoff").cast("timestamp"))
    has_bounds = {"yhat_lower", "yhat_upper"} <= set(cv.columns)
    parts = {
        "mse": err * err,
        "mae": F.abs(err),
        "mape": F.try_divide(F.abs(err), F.abs(y)),
        "smape": F.coalesce(
            F.try_divide(F.abs(err), (F.abs(y) + F.abs(yhat)) / 2), F.lit(0.0)
        ),
    }
    if has_bounds:
        parts["coverage"] = y.between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double")
    rows = cv.withColumn("horizon", horizon)
    groups = rows.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.abs(y) < 1e-8).alias("_zero"),
        *[F.sum(c).alias(f"_x_{m}") for m, c in parts.items()],
    )
    # One row per key and horizon step from here on.
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    cum = groups.withColumns(
        {"_cn": F.sum("_n").over(upto)} | {f"_c_{m}": F.sum(f"_x_{m}").over(upto) for m in parts}
    )
    cum = cum.withColumns({"_all": F.sum("_n").over(whole), "_anyzero": F.sum("_zero").over(whole) > 0})
    cum = cum.withColumn("_w", F.greatest(F.floor(F.col("_all") * F.lit(rolling_window)), F.lit(1)))
    # The oldest horizon of each window: the last one that starts at or before the row that leaves.
    step = F.struct(
        "_cn", "_n", *[F.col(f"_c_{m}").alias(f"c_{m}") for m in parts],
        *[F.col(f"_x_{m}").alias(f"x_{m}") for m in parts],
    )
    starts = cum.select(*keys, (F.col("_cn") - F.col("_n")).alias("_pos"), F.lit(0).alias("_ask"), step.alias("_step"))
    asks = cum.filter(F.col("_cn") >= F.col("_w")).withColumns(
        {"_pos": F.col("_cn") - F.col("_w"), "_ask": F.lit(1)}
    )
    line = whole.orderBy("_pos", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    cum = asks.unionByName(starts, allowMissingColumns=True)
    cum = cum.withColumn("_at", F.last("_step", ignorenulls=True).over(line)).filter("_ask = 1")
    gone = F.col("_cn") - F.col("_w")  # rows older than the window
    cum = cum.withColumn("_at", F.when(gone > 0, F.col("_at")))
    out = {}
    for m in parts:
        before = (
            F.col("_at")[f"c_{m}"] - F.col("_at")[f"x_{m}"]
            + F.col("_at")[f"x_{m}"] * (gone - (F.col("_at")["_cn"] - F.col("_at")["_n"])) / F.col("_at")["_n"]
        )
        out[m] = (F.col(f"_c_{m}") - F.coalesce(before, F.lit(0.0))) / F.col("_w")
    out["mape"] = F.when(~F.col("_anyzero"), out["mape"])
    table = cum.withColumns(out).withColumn("rmse", F.sqrt("mse"))
    names = ["mse", "rmse", "mae", "mape", "mdape", "smape"] + (["coverage"] if has_bounds else [])
    if not median:  # the one metric that is no mean
        return table.select(*keys, "horizon", *[n for n in names if n != "mdape"])
    table = table.join(_rolling_median(rows, parts["mape"], cum, keys), [*keys, "horizon"], "left")
    table = table.withColumn("mdape", F.when(~F.col("_anyzero"), F.col("mdape")))
    return table.select(*keys, "horizon", *names)


def _rolling_median(rows: DataFrame, ape: Column, cum: DataFrame, keys: list[str]) -> DataFrame:
    """Median error at each horizon: its own rows, and the rows just before until w are in.

    Rows are numbered along the horizon and cut into blocks as long as the longest window, so a
    window lies in the block of its end and the one before: every row goes to two blocks, whatever
    the number of windows that hold it. A task slides over its two blocks.
    """
    # Rows per key are cutoffs x horizon steps of one cross-validation, not the key's history.
    whole = Window.partitionBy(*keys)
    spans = cum.select(*keys, "horizon", "_cn", F.greatest("_n", "_w").alias("_long"))
    spans = spans.withColumn("_block", F.max("_long").over(whole))
    sizes = spans.groupBy(*keys).agg(F.first("_block").alias("_block"))
    ranked = rows.select(*keys, ape.alias("_ape"), F.row_number().over(whole.orderBy("horizon", "ds")).cast("long").alias("_to"))
    ranked = ranked.join(sizes, keys).withColumn("_part", F.floor((F.col("_to") - 1) / F.col("_block")))
    held = ranked.select(*keys, F.explode(F.array("_part", F.col("_part") + 1)).alias("_part"), "_to", "_ape")
    asks = spans.select(
        *keys, F.floor((F.col("_cn") - 1) / F.col("_block")).alias("_part"), F.col("_cn").alias("_to"), "horizon",
        (F.col("_cn") - F.col("_long") + 1).alias("_from"),
    )
    both = held.unionByName(asks, allowMissingColumns=True)

    def slide(part: pd.DataFrame) -> pd.DataFrame:
        asked = part["_from"].notna()
        windows = part[asked].sort_values("_to")
        line = part[~asked].sort_values("_to")
        out = windows[[*keys, "horizon"]].copy()
        out["horizon"] = out["horizon"].astype("int64")
        start = int(line["_to"].iloc[0]) if len(line) else 0
        out["mdape"] = sliding_medians(
            line["_ape"].to_numpy(float), windows["_from"].to_numpy(np.int64) - start, windows["_to"].to_numpy(np.int64) - start + 1
        )
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", horizon bigint, mdape double"
    return both.groupBy(*keys, "_part").applyInPandas(slide, schema)


def sliding_medians(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Median of ``values[start:stop]`` for windows whose ends never go back; NaN is no value.

    The window is a set of ranks, counted by blocks of about the square root of all: a row in or
    out is one count, and a median is found by its block, then inside it.
    """
    rank = np.empty(len(values), np.int64)
    order = np.argsort(values, kind="stable")
    rank[order] = np.arange(len(values))
    known = np.isfinite(values)
    shift = max(1, int(np.log2(max(len(values), 2)) / 2) + 1)
    blocks = np.zeros((len(values) >> shift) + 1, np.int64)
    present = np.zeros(len(blocks) << shift, bool)
    out = np.full(len(starts), np.nan)
    low = high = 0
    for i, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist())):
        for lo, hi, here in ((high, stop, True), (low, start, False)):
            moved = rank[lo:hi][known[lo:hi]]
            present[moved] = here
            np.add.at(blocks, moved >> shift, 1 if here else -1)
        low, high = start, stop
        upto = np.cumsum(blocks)
        count = int(upto[-1])
        if count:
            middle = []
            for k in {(count - 1) // 2, count // 2}:
                b = int(np.searchsorted(upto, k, "right"))
                inside = np.flatnonzero(present[b << shift : (b + 1) << shift])
                middle.append(values[order[(b << shift) + inside[k - (upto[b] - blocks[b])]]])
            out[i] = sum(middle) / len(middle)
    return out


def param_importance(results: DataFrame, params: Sequence[str], metric: str = "rmse", keys: Sequence[str] = ()) -> DataFrame:
    """Share of each parameter in the spread of the mean metric across its values."""
    keys = list(keys)
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in params]
        )
    )
    means = (
        results.select(*keys, metric, pairs.alias("_p"))
        .groupBy(*keys, "_p.param", "_p.value")
        .agg(F.avg(metric).alias("_mean"))
    )
    spread = means.groupBy(*keys, "param").agg(
        F.coalesce(F.var_samp("_mean"), F.lit(0.0)).alias("_var")
    )
    # One row per parameter here.
    total = F.sum("_var").over(Window.partitionBy(*keys, F.lit(0)))
    return spread.select(*keys, "param", F.try_divide("_var", total).alias("importance"))


def best_params(scores: DataFrame, params: Sequence[str], metric: str = "rmse", keys: Sequence[str] = ("key",), order: str = "param_id") -> DataFrame:
    """The parameter set with the least metric per key; the first one wins a tie."""
    chosen = F.min_by(F.struct(order, *params, metric), F.struct(metric, order))
    known = scores.filter(F.col(metric).isNotNull())
    return known.groupBy(*keys).agg(chosen.alias("_b")).select(*keys, "_b.*")



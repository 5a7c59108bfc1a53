"""Forecasts from fitted parameters.

The forecast and its components are column expressions over rows joined with their key's
parameters: no grouping, no shuffle beyond that join. Intervals come from simulated trend
changes. Their random numbers depend on the key alone, so rows may meet the simulation in any
batch and one narrow Arrow pass does for all rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.models.design import ForecastOptions, fourier, scaled_time
from tidemark.models.fit import key_schema
from tidemark.plans.segments import attach
from tidemark.plans.series import Series

PATH_TIMES = 1024  # times whose simulated paths are held together
FORECAST_COLUMNS = ("yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly", "daily")


def _compact(params: DataFrame, keys: list[str]) -> DataFrame:
    """What a row needs of its key's parameters, prepared once per key rather than per row.

    Slope changes that the prior shrank to nothing are left out: each row walks the rest.
    """
    theta, n_cps = F.col("trend"), F.size("cps").cast("double")
    sizes = F.slice(theta, 3, F.greatest(F.size(theta) - 2, F.lit(0)))
    pairs = F.zip_with(sizes, "cps", lambda c, at: F.struct(c.alias("change"), at.alias("at")))
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, v: acc + F.abs(v))
    slope = F.when(F.col("growth") == "logistic", F.col("cap") / 4).otherwise(F.lit(1.0))
    return params.select(
        *keys, "growth", "mode", "t0", "t1", "y_scale", "floor", "cap", "beta", "reg_mean",
        "reg_std", "reg_beta", "sigma",
        F.get(theta, F.lit(0)).alias("_level"), F.get(theta, F.lit(1)).alias("_slope"),
        F.filter(pairs, lambda p: F.abs(p["change"]) > 1e-12).alias("_bends"),
        n_cps.alias("_rate"),
        (F.coalesce(F.try_divide(total, n_cps), F.lit(0.0)) * slope).alias("_change"),
    )


def point_forecast(rows: DataFrame, ds: str, options: ForecastOptions) -> DataFrame:
    """Add yhat, trend and components to rows that carry their key's parameters."""
    t = scaled_time(F.col(ds))
    line = F.col("_level") + F.col("_slope") * t
    line = line + F.aggregate(
        "_bends", F.lit(0.0), lambda acc, p: acc + p["change"] * F.greatest(t - p["at"], F.lit(0.0))
    )
    logistic = F.col("cap") / (1 + F.exp(-line))
    trend = F.when(F.col("growth") == "logistic", logistic).otherwise(line)
    df = rows.withColumns({"_t": t, "_g": trend})
    at, parts = 0, {}
    for season in options.seasons():
        terms = [
            F.get("beta", F.lit(at + i)) * wave for i, wave in enumerate(fourier(F.col(ds), season))
        ]
        at += len(terms)
        parts[season.name] = sum(terms[1:], terms[0])
    extra = F.lit(0.0)
    for i, name in enumerate(options.regressors):
        z = (F.col(name) - F.get("reg_mean", F.lit(i))) / F.get("reg_std", F.lit(i))
        extra = extra + F.get("reg_beta", F.lit(i)) * z
    names = list(dict.fromkeys([*parts, "yearly", "weekly", "daily"]))
    df = df.withColumns({**{f"_s_{n}": parts.get(n, F.lit(0.0)) for n in names}, "_x": extra})
    total = F.col("_x")
    for n in names:
        total = total + F.col(f"_s_{n}")
    product = F.col("mode") == "multiplicative"
    df = df.withColumn("_lift", F.when(product, 1 + total).otherwise(F.lit(1.0)))
    scaled = F.when(product, F.col("_g") * (1 + total)).otherwise(F.col("_g") + total)
    unit = F.when(product, F.lit(1.0)).otherwise(F.col("y_scale"))
    return df.withColumns(
        {
            "yhat": scaled * F.col("y_scale") + F.col("floor"),
            "trend": F.col("_g") * F.col("y_scale") + F.col("floor"),
            # Multiplicative components are shares of the trend, additive ones are in y.
            **{n: F.col(f"_s_{n}") * unit for n in names},
        }
    ).drop("_x", "_g", *[f"_s_{n}" for n in names])


def simulate_deviation(
    t: np.ndarray, rate: float, change: float, sigma: float, lift: np.ndarray, samples: int,
    width: float, seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Interval of (trend change effect * lift + noise) at scaled times t, by simulation.

    After t = 1 slope changes come at the past rate with the past mean size. The j-th change of
    all sample paths has a generator of its own, so the result at a time does not depend on
    which other times are asked for.
    """
    noise = np.random.default_rng([seed, 0]).normal(0, sigma, samples)
    jumps, at, last, j = [], np.ones(samples), float(t.max(initial=1.0)), 0
    while rate > 0 and (at < last).any():
        j += 1
        rng = np.random.default_rng([seed, j])
        at = at + rng.exponential(1 / rate, samples)
        jumps.append((at, rng.laplace(0, change + 1e-8, samples)))
    low, high = np.empty(len(t)), np.empty(len(t))
    for a in range(0, len(t), PATH_TIMES):  # the paths of some times, whatever the horizon
        part = slice(a, a + PATH_TIMES)
        bend = np.zeros((samples, len(t[part])))
        for start, size in jumps:
            bend += size[:, None] * np.maximum(t[part][None, :] - start[:, None], 0.0)
        spread = bend * lift[part][None, :] + noise[:, None]
        low[part], high[part] = np.quantile(spread, [0.5 - width / 2, 0.5 + width / 2], axis=0)
    return np.minimum(low, 0.0), np.maximum(high, 0.0)


def predict(
    params: DataFrame, frame: Series, options: ForecastOptions = ForecastOptions(), seed: int = 42
) -> DataFrame:
    """Forecast the rows of ``frame``: keys, time and any regressor columns.

    ``params`` comes from a fit; rows of keys whose fit failed (or that have none) come back with
    NULL forecasts, and ``params`` says why. Rows up to the last training time get the noise interval, later rows that of the simulated trend as well.
    """
    keys, ds = list(frame.keys), frame.ds
    ok = _compact(params.filter(F.col("status") == "ok"), keys)
    rows = attach(frame, ok)
    names = list(dict.fromkeys([*(x.name for x in options.seasons()), "yearly", "weekly", "daily"]))
    out = [*keys, ds, "yhat", "yhat_lower", "yhat_upper", "trend", *names]
    df = point_forecast(rows, ds, options).select(
        *keys, ds, "yhat", "trend", *names, "_t", "_lift", "_rate", "_change", "sigma", "y_scale",
        F.xxhash64(F.lit(seed), *keys).alias("_seed"),
    )
    samples, width = options.samples, options.interval_width

    def bounds(batches):
        reach = NormalDist().inv_cdf(0.5 + width / 2)
        for rows in batches:
            low = -reach * rows["sigma"].to_numpy()
            high = -low
            t, lift = rows["_t"].to_numpy(), rows["_lift"].to_numpy()
            ahead = np.flatnonzero(t > 1)
            for _, at in rows.iloc[ahead].groupby("_seed", sort=False).indices.items():
                at = ahead[at]
                head = rows.iloc[at[0]]
                low[at], high[at] = simulate_deviation(
                    t[at], head["_rate"], head["_change"], head["sigma"], lift[at], samples, width,
                    int(head["_seed"]) & ((1 << 63) - 1),
                )
            scale, yhat = rows["y_scale"].to_numpy(), rows["yhat"].to_numpy()
            rows["yhat_lower"], rows["yhat_upper"] = yhat + low * scale, yhat + high * scale
            yield rows[out]

    kinds = {f.name: f.dataType.simpleString() for f in frame.df.schema.fields}
    schema = f"{key_schema(frame.df, keys)}, `{ds}` {kinds[ds]}, " + ", ".join(
        f"`{c}` double" for c in out[len(keys) + 1 :]
    )
    return df.mapInPandas(bounds, schema)


def report_table(forecast: DataFrame, history_end: DataFrame, periods: int, keys=("key",), ds: str = "ds") -> DataFrame:
    """The last ``periods`` future rows of each key with their bounds."""
    future = forecast.join(history_end, list(keys)).filter(F.col(ds) > F.col("last_ds"))
    w = Window.partitionBy(*keys).orderBy(F.col(ds).desc())
    last = future.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= periods)
    return last.select(*keys, ds, "yhat", "yhat_lower", "yhat_upper")

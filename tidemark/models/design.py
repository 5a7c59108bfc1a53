"""Design of the decomposable forecaster: scaled time, trend hinges and seasonal waves.

The same design exists as Spark columns (prediction and long-series fitting) and as NumPy
arrays (fitting one bounded series inside a task). Tests hold the two together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.segments import numbered, planned
from tidemark.plans.series import Series

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Season:
    name: str
    period: float  # days
    order: int


# The built-in seasonalities (period in days, Fourier order).
YEARLY = Season("yearly", 365.25, 10)
WEEKLY = Season("weekly", 7.0, 3)
DAILY = Season("daily", 1.0, 4)


@dataclass(frozen=True)
class ForecastOptions:
    """Options of the forecaster. A seasonality is True, False, 'auto' or a Fourier order."""

    growth: str = "linear"
    seasonality_mode: str = "multiplicative"
    yearly: bool | str | int = True
    weekly: bool | str | int = True
    daily: bool | str | int = True
    custom: tuple[Season, ...] = ()
    changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    regressors: tuple[str, ...] = ()
    interval_width: float = 0.95
    samples: int = 1000
    sweeps: int = 25  # most rounds of Gauss-Newton steps; they end sooner when nothing moves

    def __post_init__(self):
        if self.growth not in ("linear", "logistic"):
            raise ValueError("growth is 'linear' or 'logistic'")
        if self.seasonality_mode not in ("additive", "multiplicative"):
            raise ValueError("seasonality_mode is 'additive' or 'multiplicative'")

    def seasons(self) -> tuple[Season, ...]:
        """Seasonalities with a place in the coefficient array; 'auto' may zero some per key."""
        out = []
        for base, choice in ((YEARLY, self.yearly), (WEEKLY, self.weekly), (DAILY, self.daily)):
            if choice is False:
                continue
            numbered_order = isinstance(choice, int) and not isinstance(choice, bool)
            out.append(replace(base, order=choice) if numbered_order else base)
        return (*out, *self.custom)

    def with_params(self, params: dict) -> ForecastOptions:
        known = {k: v for k, v in params.items() if k in self.__dataclass_fields__}
        return replace(self, **known)


def logistic_options(**changes) -> ForecastOptions:
    """Logistic growth looks for breaks in the first 90 % of the history."""
    return ForecastOptions(**{"growth": "logistic", "changepoint_range": 0.9, **changes})


# --- as Spark columns ------------------------------------------------------------------------------


def days(ds: Column) -> Column:
    return F.unix_micros(ds.cast("timestamp")) / F.lit(float(DAY_US))


def fourier(ds: Column, season: Season) -> list[Column]:
    """sin, cos of each harmonic, on days since the epoch."""
    angle = 2 * F.pi() * days(ds) / F.lit(season.period)
    return [f(angle * k) for k in range(1, season.order + 1) for f in (F.sin, F.cos)]


def time_scales(s: Series, options: ForecastOptions = ForecastOptions()) -> DataFrame:
    """Per key: first and last time, target scale and changepoint times (scaled).

    Changepoints stand on evenly spaced ranks of the first part of the history. The ranks meet
    the rows by an equality join on the row number, so no history is gathered.
    """
    s = planned(s)
    keys = list(s.keys)
    ends = s.df.groupBy(*keys).agg(
        F.min(F.unix_micros(F.col(s.ds).cast("timestamp"))).alias("t0"),
        F.max(F.unix_micros(F.col(s.ds).cast("timestamp"))).alias("t1"),
        F.max(F.abs(s.y)).alias("y_scale"),
        F.count(F.lit(1)).alias("n"),
    )
    part = F.floor(F.col("n") * options.changepoint_range)
    count = F.least(F.lit(options.changepoints), part - 1)
    j = F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).alias("_j")
    places = ends.filter(count >= 1).select(*keys, part.alias("_part"), count.alias("_count"), j)
    places = places.filter(F.col("_j") <= F.col("_count")).select(
        *keys,
        (F.rint(F.col("_j") * (F.col("_part") - 1) / F.col("_count")).cast("long") + 1).alias("_rn"),
    )
    rows = numbered(s, "_rn").select(*keys, "_rn", F.unix_micros(F.col(s.ds).cast("timestamp")).alias("_us"))
    times = rows.join(places, [*keys, "_rn"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_us")).alias("_cps")
    )
    span = F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    cps = F.transform(F.coalesce("_cps", F.array().cast("array<bigint>")), lambda c: (c - F.col("t0")) / span)
    return ends.join(times, keys, "left").select(
        *keys, "t0", "t1", F.when(F.col("y_scale") > 0, F.col("y_scale")).otherwise(1.0).alias("y_scale"),
        "n", cps.alias("cps"),
    )


def scaled_time(ds: Column) -> Column:
    us = F.unix_micros(ds.cast("timestamp"))
    return (us - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))


def hinges(t: Column) -> Column:
    """max(t - c, 0) for every changepoint c."""
    return F.transform("cps", lambda c: F.greatest(t - c, F.lit(0.0)))


def design_matrix(
    s: Series, scales: DataFrame, options: ForecastOptions = ForecastOptions()
) -> DataFrame:
    """t, hinge and seasonal columns of every row; ``scales`` has one row per key."""
    from tidemark.plans.segments import attach

    df = attach(s, scales).withColumn("t", scaled_time(F.col(s.ds)))
    waves = {}
    for season in options.seasons():
        for i, c in enumerate(fourier(F.col(s.ds), season)):
            wave = "sin" if i % 2 == 0 else "cos"
            waves[f"{season.name}_{wave}_{i // 2 + 1}"] = c
    return df.withColumns({"hinges": hinges(F.col("t")), **waves}).drop("t0", "t1", "n", "cps")


# --- as NumPy arrays ----------------------------------------------------------------------------------


def trend_basis(t: np.ndarray, cps: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - cps[None, :], 0.0)])


def season_basis(day: np.ndarray, seasons: Sequence[Season]) -> np.ndarray:
    waves = []
    for season in seasons:
        angle = 2 * np.pi * day / season.period
        for k in range(1, season.order + 1):
            waves += [np.sin(k * angle), np.cos(k * angle)]
    return np.column_stack(waves) if waves else np.zeros((len(day), 0))


def changepoint_times(t: np.ndarray, options: ForecastOptions) -> np.ndarray:
    part = int(np.floor(len(t) * options.changepoint_range))
    count = min(options.changepoints, part - 1)
    if count < 1:
        return np.zeros(0)
    ranks = np.rint(np.arange(1, count + 1) * (part - 1) / count).astype(int)
    return t[ranks]


def active_seasons(day: np.ndarray, options: ForecastOptions) -> list[bool]:
    """The 'auto' rule: two full cycles of data, sampled finer than the cycle."""
    span = float(day[-1] - day[0]) if len(day) else 0.0
    step = float(np.diff(day).min()) if len(day) > 1 else np.inf
    auto = {"yearly": span >= 730, "weekly": span >= 14 and step < 7, "daily": span >= 2 and step < 1}
    choices = {"yearly": options.yearly, "weekly": options.weekly, "daily": options.daily}
    return [
        auto[x.name] if choices.get(x.name) == "auto" and x not in options.custom else True
        for x in options.seasons()
    ]

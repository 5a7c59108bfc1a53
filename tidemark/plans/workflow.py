"""The whole way from raw rows to an evaluated forecast, for all keys at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.cv import carry_regressors, cv_cutoffs, data_driven_cutoffs, future_frame
from tidemark.models.design import ForecastOptions
from tidemark.models.fit import fit
from tidemark.models.predict import predict
from tidemark.models.tune import cross_validate, fit_best, grid_search
from tidemark.operators.clean import clean
from tidemark.operators.features import prepare, split_train_test
from tidemark.operators.indicators import calculate_indicators
from tidemark.operators.metrics import evaluate_forecast, forecast_summary, performance_metrics, with_actual
from tidemark.operators.profile import null_profile, validate_series, value_profile
from tidemark.plans.series import Series, regressor_columns
from tidemark.session import settled, settled_in_place
from tidemark.sources.bars import target_to_close


@dataclass(frozen=True)
class WorkflowConfig:
    missing: str = "impute"
    outliers: str = "zscore"
    treatment: str = "clip"
    indicators: Sequence[str] = ("trend", "momentum")
    test_ratio: float = 0.2
    periods: int = 30
    include_history: bool = True
    options: ForecastOptions = field(default_factory=ForecastOptions)
    grid: dict | None = None
    initial: str | None = None
    period: str = "30 days"
    horizon: str = "60 days"
    with_features: bool = True
    # Regressors of the forecaster among the prepared features; None takes all that qualify.
    regressors: Sequence[str] | None = None
    cross_validate: bool = False


def run_workflow(s: Series, config: WorkflowConfig = WorkflowConfig()) -> dict[str, DataFrame]:
    """Quality, cleaning, indicators, features, fit, validation, forecast and evaluation.

    With ``with_features`` the models are trained on the prepared features: their split, and their
    columns as regressors, whose last known values go on into the future. Without, on the cleaned
    target alone. Tables of the result are computed when they are read, but building them runs jobs:
    preparation writes the features and a grid search the folds' forecasts.
    """
    out: dict[str, DataFrame] = {
        "validation": validate_series(s),
        "nulls_before": null_profile(s.df, s.keys),
    }
    cleaned = clean(s, config.missing, config.outliers, config.treatment)
    out["cleaned"] = cleaned.df
    out["nulls_after"] = null_profile(cleaned.df, s.keys)
    out["values_after"] = value_profile(cleaned.df, keys=s.keys)
    charted = calculate_indicators(cleaned.on(target_to_close(cleaned.df)), config.indicators)
    out["indicators"] = charted.df
    regressors: tuple[str, ...] = ()
    if config.with_features:
        split, _ = prepare(charted, config.test_ratio)
        # Fit, future rows, carried regressors and evaluation read the features. Those of bounded series lie
        # in buckets of their key, where scaling is done again for less than a second table; folds read them often.
        if not split.bounded or config.grid or config.cross_validate:
            split = split.on(settled_in_place(split.df, s.keys) if split.bounded else settled(split.df))
        out["features"] = split.df
        found = [c for c in regressor_columns(split) if c not in ("Open", "High", "Low", "Close")]
        regressors = tuple(found if config.regressors is None else config.regressors)
    else:
        split = split_train_test(cleaned, config.test_ratio)
    options = replace(config.options, regressors=(*config.options.regressors, *regressors))
    train = split.filtered(split.df.filter("is_train").drop("is_train"))
    test = split.df.filter(~F.col("is_train")).select(*s.keys, F.col(s.ds).alias("ds"), F.col(s.y).alias("y"))
    if config.grid or config.cross_validate:
        if config.initial:
            cutoffs = cv_cutoffs(train, config.initial, config.period, config.horizon)
        else:
            cutoffs = data_driven_cutoffs(train)
    if config.grid:
        scores, best = grid_search(train, cutoffs, config.grid, options)
        out["scores"], out["best"] = scores, best
        params = fit_best(train, best, config.grid, options)
    else:
        params = fit(train, options)
    out["params"] = params
    if config.cross_validate:
        cv = settled(cross_validate(train, cutoffs, options))
        out["cv"] = cv
        good = cv.filter(F.col("error").isNull())
        out["cv_metrics"] = performance_metrics(good, keys=s.keys)

    # History and future are forecast apart, each where its rows lie; what is evaluated is the future.
    ahead = future_frame(train, config.periods, include_history=False).drop("is_future")
    if options.regressors:
        ahead = carry_regressors(train, ahead, options.regressors)
    frame = s.reordered(ahead, s.ds, max_rows=config.periods if s.bounded else None)
    future = predict(params, frame, options)
    out["forecast"] = future
    if config.include_history:
        past = train.df.select(*s.keys, s.ds, *options.regressors)
        past = s.reordered(past, s.ds, max_rows=s.max_rows if s.bounded else None)
        out["forecast"] = predict(params, past, options).unionByName(future)
    future = future.dropna(subset=list(s.keys))
    out["summary"] = forecast_summary(frame.on(future), config.periods)
    out["metrics"] = evaluate_forecast(with_actual(future, test, s.keys), keys=s.keys)
    return out

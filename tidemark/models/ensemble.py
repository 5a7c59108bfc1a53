"""Base models and their combination. Predictions are long: keys, ds, model, yhat."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.models.design import ForecastOptions
from tidemark.models.fit import fit, key_schema
from tidemark.models.predict import predict
from tidemark.operators.features import regressor_features
from tidemark.plans.segments import BASE, SEG, attach, fill, planned, segment, settle, windowed
from tidemark.plans.series import Series, numeric_columns, string_columns, whole_keys
from tidemark.session import settled

# The date parts that trees take.
DATE_PARTS = ("year", "month", "day", "dayofweek", "quarter")
MOST_TEXTS = 100  # texts of a column that trees tell apart, by frequency; others are one more case

# --- base models ------------------------------------------------------------------------------------

# Smoothing factors tried for level, trend and season; the least squared error wins.
SMOOTHING_GRID = {
    "level": (0.1, 0.3, 0.5, 0.8),
    "trend": (0.01, 0.1, 0.3),
    "season": (0.05, 0.1, 0.3, 0.6),
}


def _factors() -> tuple[np.ndarray, ...]:
    """Level, trend and season factors of all combinations, which advance together."""
    return tuple(np.array(v) for v in zip(*itertools.product(*SMOOTHING_GRID.values())))


def start_smoothing(head: np.ndarray, period: int) -> np.ndarray:
    """Level, slope and the season's waves before the first row, from the first two periods."""
    first, second = head[:period].mean(), head[period : 2 * period].mean()
    step = (second - first) / period
    line = first + step * (np.arange(2 * period) - (period - 1) / 2)
    waves = (head[: 2 * period] - line).reshape(2, period).mean(axis=0)
    return np.concatenate([[line[0] - step, step], waves])


def run_smoothing(y: np.ndarray, start: int, state: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared errors and end states of all combinations over ``y``, whose first row is number ``start``.

    ``state`` has one row per combination: level, slope, waves. With blocks beside each other, ``y`` has
    a column and ``state`` a second index for each.
    """
    a, b, g = (v.reshape(-1, *[1] * (state.ndim - 2)) for v in _factors())
    level, slope, season = state[..., 0], state[..., 1], np.moveaxis(state[..., 2:], -1, 0).copy()
    sse = np.zeros(level.shape)
    for i, value in enumerate(y, start):
        wave = season[i % period]
        sse += (value - (level + slope + wave)) ** 2
        old = level
        level = a * (value - wave) + (1 - a) * (level + slope)
        slope = b * (level - old) + (1 - b) * slope
        season[i % period] = g * (value - level) + (1 - g) * wave
    return sse, np.concatenate([level[..., None], slope[..., None], np.moveaxis(season, 0, -1)], axis=-1)


BLOCKS = 64  # parts of a segment that advance together


def _parts(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of whole periods beside each other, (rows, blocks), and the rest."""
    length = period * max(1, -(-len(y) // (period * BLOCKS)))
    whole = len(y) // length * length
    return y[:whole].reshape(-1, length).T, y[whole:]


def _block_maps(y: np.ndarray, start: int, period: int) -> np.ndarray:
    """The end state of each block as an affine map of its first: (blocks, combinations, state, state + 1).

    Each part of the state is kept as a row of weights on the state at the beginning and 1, so a
    step changes three such rows, whatever the period.
    """
    a, b, g = (v[:, None, None] for v in _factors())
    size = period + 2
    rows = np.broadcast_to(np.eye(size, size + 1)[:, None, None, :], (size, len(a), y.shape[1], size + 1)).copy()
    for i, value in enumerate(y, start):
        at = 2 + i % period
        wave, old = rows[at], rows[0]
        level = (1 - a) * (old + rows[1]) - a * wave
        level[..., -1] += a[..., 0] * value
        rows[1] = b * (level - old) + (1 - b) * rows[1]
        rows[0] = level
        rows[at] = (1 - g) * wave - g * level
        rows[at][..., -1] += g[..., 0] * value
    return rows.transpose(2, 1, 0, 3)


def smoothing_maps(y: np.ndarray, start: int, period: int) -> np.ndarray:
    """The end state as an affine map of the state before ``y``: (combinations, state, state + 1)."""
    blocks, rest = _parts(y, period)
    size = period + 2
    whole = np.broadcast_to(np.eye(size, size + 1), (len(_factors()[0]), size, size + 1))
    for m in [*_block_maps(blocks, start, period), *_block_maps(rest[:, None], start, period)]:
        whole = m[..., :size] @ whole + np.pad(m[..., size:], [(0, 0), (0, 0), (size, 0)])
    return whole


def run_segment(y: np.ndarray, start: int, state: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``run_smoothing`` gives over a segment, whose blocks begin at the states that their maps chain to."""
    blocks, rest = _parts(y, period)
    begun = []
    for m in _block_maps(blocks, start, period):
        begun.append(state)
        state = (m[..., :-1] @ state[..., None])[..., 0] + m[..., -1]
    sse = np.zeros(len(state))
    if begun:
        sse += run_smoothing(blocks, start, np.stack(begun, axis=1), period)[0].sum(axis=1)
    last, state = run_smoothing(rest, start, state, period)
    return sse + last, state


def smooth_arrays(y: np.ndarray, steps: int, period: int = 30) -> np.ndarray:
    """Holt-Winters with additive trend and season; all smoothing factors advance together."""
    if len(y) < 2 * period:
        raise ValueError(f"exponential smoothing needs {2 * period} rows, got {len(y)}")
    head = start_smoothing(y, period)
    sse, states = run_smoothing(y, 0, np.tile(head, (len(_factors()[0]), 1)), period)
    best = states[int(np.argmin(sse))]
    ahead = np.arange(1, steps + 1)
    return best[0] + ahead * best[1] + best[2:][(len(y) + ahead - 1) % period]


SMOOTHED_ROWS = 200_000  # rows of whole keys that a task smooths at a time; a longer key makes more
BESIDE, PADDED = 256, 1_000_000  # series that advance together at most, and values of their array


def smooth_together(ys: Sequence[np.ndarray], steps: Sequence[int], period: int = 30) -> list[np.ndarray]:
    """What ``smooth_arrays`` gives for each series, the same to the last bit; all advance together.

    The longest come first, so a series that ends is cut off the right side of the arrays.
    """
    order = sorted(range(len(ys)), key=lambda k: -len(ys[k]))
    out: list = [None] * len(ys)
    a, b, g = (v[:, None] for v in _factors())
    while order:
        width = max(1, min(BESIDE, PADDED // max(len(ys[order[0]]), 1)))
        part, order = order[:width], order[width:]
        lengths = np.array([len(ys[k]) for k in part])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # series with a row at each place
        y = np.zeros((lengths[0], len(part)))
        for j, k in enumerate(part):
            y[: lengths[j], j] = ys[k]
        start = np.stack([start_smoothing(ys[k], period) for k in part], axis=1)
        sse, level, slope = (np.repeat(v[None], len(a), axis=0) for v in (np.zeros(len(part)), start[0], start[1]))
        season = np.repeat(start[2:, None], len(a), axis=1)
        for i, n in enumerate(active.tolist()):
            value, wave = y[i, :n], season[i % period, :, :n]
            old, down = level[:, :n].copy(), slope[:, :n]
            sse[:, :n] += (value - (old + down + wave)) ** 2
            new = a * (value - wave) + (1 - a) * (old + down)
            level[:, :n] = new
            slope[:, :n] = b * (new - old) + (1 - b) * down
            season[i % period, :, :n] = g * (value - new) + (1 - g) * wave
        best = np.argmin(sse, axis=0)
        for j, k in enumerate(part):
            ahead, c = np.arange(1, steps[k] + 1), best[j]
            out[k] = level[c, j] + ahead * slope[c, j] + season[(lengths[j] + ahead - 1) % period, c, j]
    return out


def _smoothed(period: int, shown: Sequence[str]):
    """Forecasts of whole keys: ``_place`` numbers a key's rows, the known ones first."""

    def forecast(rows: pa.Table) -> pa.Table:
        known = rows.column("_known").to_numpy()
        head = np.flatnonzero(rows.column("_place").to_numpy() == 1)
        n = np.add.reduceat(known.astype(np.int64), head)
        ahead = np.diff(np.append(head, len(known))) - n
        y = rows.column("_y").to_numpy()
        asked = [k for k in range(len(head)) if ahead[k] and n[k] >= 2 * period]
        found = smooth_together([y[head[k] : head[k] + n[k]] for k in asked], [int(ahead[k]) for k in asked], period)
        yhat = np.full(len(known), np.nan)
        for k, v in zip(asked, found):
            yhat[head[k] + n[k] : head[k] + n[k] + ahead[k]] = v
        told = pa.array(["ok" if c >= 2 * period else f"needs {2 * period} rows, got {c}" for c in n.tolist()], pa.string())
        status = told.take(pa.array(np.repeat(np.arange(len(head)), n + ahead)))
        out = rows.select(list(shown)).append_column("yhat", pa.array(yhat, mask=np.isnan(yhat))).append_column("status", status)
        return out.filter(pa.array(~known))

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in whole_keys(batches, SMOOTHED_ROWS):
            yield from forecast(rows).to_batches()

    return run


def exp_smoothing(train: Series, target: DataFrame, period: int = 30) -> DataFrame:
    """Forecast the rows of ``target`` (keys, ds) in their order after the training rows.

    Every row comes back: a key with too short a history has NULL forecasts and says so in status.
    A key of a bounded series is smoothed by one task, many keys beside each other; long ones by
    segments, with the same result.
    """
    keys = list(train.keys)
    ahead = target.select(*keys, F.col(train.ds).alias("ds"))
    known = planned(settle(train.filtered(train.df.where(F.col(train.y).isNotNull()))))
    if not known.bounded:
        return _smooth_long(known, ahead, period)
    # Both kinds of rows stream past in order: a key's training rows, then those to forecast. A target column
    # comes along unread, so that two parts of one table share its scan and shuffle.
    at = {f"_at{i}": F.col(c) for i, c in enumerate(known.order)}
    value = F.col(train.y).cast("double").alias("_y")
    rows = known.df.select(*keys, F.lit(True).alias("_known"), *[c.alias(n) for n, c in at.items()], value)
    asked = target.select(
        *keys, F.lit(False).alias("_known"), F.col(train.ds).alias("ds"), *([value] if train.y in target.columns else [])
    )
    place = Window.partitionBy(*keys).orderBy(F.desc("_known"), *at, F.asc_nulls_last("ds"))
    rows = rows.unionByName(asked, allowMissingColumns=True).withColumn("_place", F.row_number().over(place))
    rows = rows.select(*keys, "ds", "_known", "_y", "_place")
    kinds = {f.name: f.dataType.simpleString() for f in ahead.schema.fields}
    schema = f"{key_schema(train.df, keys)}, ds {kinds['ds']}, yhat double, status string"
    return rows.mapInArrow(_smoothed(period, [*keys, "ds"]), schema)


def _smooth_long(known: Series, ahead: DataFrame, period: int) -> DataFrame:
    """Smoothing of keys of any length: their segments' affine maps, chained in order.

    A task turns a segment into one map per combination of factors, of a size that the period alone
    sets; maps of a key chain to the states at which its segments begin. From there each segment
    runs plainly for its squared errors, and the best combination's end state forecasts.
    """
    keys = list(known.keys)
    names = key_schema(known.df, keys)
    seg = segment(known)
    by = list(seg.part)
    place = F.col(BASE) + F.row_number().over(seg.window()) - 1
    rows = settled(seg.df.select(*by, place.cast("long").alias("i"), F.col(known.y).cast("double").alias("y")))
    heads = rows.where(F.col("i") < 2 * period).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "y"))), lambda r: r["y"]).alias("head")
    )

    def maps(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        found = smoothing_maps(part["y"].to_numpy(), int(part["i"].iloc[0]), period)
        out = pd.DataFrame({"combo": range(len(found)), "map": [m.ravel() for m in found]})
        return out.assign(**{k: part[k].iloc[0] for k in by})

    composed = rows.groupBy(*by).applyInPandas(maps, f"{names}, {SEG} long, combo int, map array<double>")

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        """States at which the segments of a key begin, for one combination."""
        part = part.sort_values(SEG)
        states = []
        if len(part["head"].iloc[0]) >= 2 * period:
            state = start_smoothing(np.asarray(part["head"].iloc[0]), period)
            for m in part["map"]:
                states.append(state)
                state = np.asarray(m).reshape(period + 2, period + 3) @ np.append(state, 1.0)
        out = part[[*keys, SEG, "combo"]].iloc[: len(states)].copy()
        out["state"] = pd.Series(states, out.index, dtype=object)
        return out

    begun = composed.join(heads, keys).groupBy(*keys, "combo").applyInPandas(
        chain, f"{names}, {SEG} long, combo int, state array<double>"
    )
    begun = begun.toDF(*begun.columns)

    def run(part: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, SEG, "combo", "sse", "state"]
        if part.empty or states.empty:
            return pd.DataFrame(columns=columns)
        part, states = part.sort_values("i"), states.sort_values("combo")
        sse, ends = run_segment(part["y"].to_numpy(), int(part["i"].iloc[0]), np.stack(states["state"]), period)
        return states.assign(sse=sse, state=list(ends))[columns]

    done = rows.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(
        run, f"{names}, {SEG} long, combo int, sse double, state array<double>"
    )
    total = done.groupBy(*keys, "combo").agg(F.sum("sse").alias("sse"), F.max_by("state", SEG).alias("state"))
    best = total.groupBy(*keys).agg(F.min_by("state", F.struct("sse", "combo")).alias("_state"))
    best = settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(best, keys, "left"))
    step = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    out = ahead.withColumn("_k", step).join(best, keys, "left")
    wave = F.get("_state", (2 + (F.col("_n") + F.col("_k") - 1) % period).cast("int"))
    yhat = F.get("_state", F.lit(0)) + F.col("_k") * F.get("_state", F.lit(1)) + wave
    short = F.concat(F.lit(f"needs {2 * period} rows, got "), F.coalesce("_n", F.lit(0)).cast("string"))
    status = F.when(F.col("_state").isNotNull(), F.lit("ok")).otherwise(short)
    return out.select(*keys, "ds", yhat.alias("yhat"), status.alias("status"))


def _pooled(s: Series, stats: DataFrame) -> DataFrame:
    """Features for one model over all keys: date parts, other columns, and the key's scale.

    The target is standardised per key, so that keys of any size share the trees.
    """
    df = regressor_features(s.on(attach(s, stats)))
    return df.withColumn("_label", F.coalesce(F.try_divide(F.col(s.y) - F.col("_mean"), F.col("_sd")), F.lit(0.0)))


def tree_features(train: Series, target: DataFrame) -> list[str]:
    """All other numeric and text columns that both sides have: what trees take by default."""
    shared = set(target.columns)
    skip = (train.y, train.ds, *train.keys, *train.seq)
    found = [*numeric_columns(train.df, skip), *string_columns(train.df, skip)]
    return [c for c in found if c in shared and c not in DATE_PARTS]


def _gaps(frames: Sequence[DataFrame], cols: Sequence[str]) -> list[str]:
    """Columns with a NULL or NaN in any of the frames."""
    found = set()
    for df in frames if cols else ():
        bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols}
        row = df.agg(*[F.coalesce(F.bool_or(b), F.lit(False)).alias(c) for c, b in bad.items()]).first()
        found |= {c for c in cols if row[c]}
    return [c for c in cols if c in found]


def tree_model(
    train: Series, target: Series, kind: str = "boosted", rounds: int = 100, depth: int = 5,
    rate: float = 0.1, seed: int = 42, features: Sequence[str] | None = None,
) -> DataFrame:
    """Boosted trees or a random forest over all keys, applied to the rows of ``target``.

    Features are date parts, the key's mean and deviation, and ``features`` (by default all other
    columns of both sides; text is numbered by frequency, at most ``MOST_TEXTS`` values). A column
    with gaps has a second one that says where, so a missing value is a case of its own and no 0.
    Rows without a target train nothing, and a key without training rows has no scale, so its
    forecast is NULL. No row of ``target`` is lost.
    """
    if kind not in ("boosted", "forest"):
        raise ValueError("kind is 'boosted' or 'forest'")
    stats = train.df.groupBy(*train.keys).agg(
        F.avg(train.y).alias("_mean"), F.stddev_pop(train.y).alias("_sd")
    )
    chosen = tree_features(train, target.df) if features is None else list(features)
    texts = [c for c in string_columns(train.df) if c in chosen]
    numbers = [c for c in chosen if c not in texts]
    gaps = _gaps((train.df, target.df), numbers)
    cols = [*DATE_PARTS, *numbers, *[f"_gap_{c}" for c in gaps], *[f"_text_{c}" for c in texts], "_mean", "_sd"]

    def whole(df: DataFrame) -> DataFrame:
        missing = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in gaps}
        df = df.withColumns({f"_gap_{c}": m.cast("double") for c, m in missing.items()})
        df = df.withColumns({c: F.when(~m, F.col(c).cast("double")).otherwise(0.0) for c, m in missing.items()})
        df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
        return df.na.fill(0.0, ["_mean", "_sd"])

    stages = []
    for c in texts:
        top = train.df.groupBy(F.coalesce(c, F.lit("")).alias("v")).count()
        top = [r["v"] for r in top.orderBy(F.desc("count"), "v").limit(MOST_TEXTS).collect()]
        stages.append(StringIndexerModel.from_labels(top, c, f"_text_{c}", "keep"))
    assemble = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="error")
    shared = dict(featuresCol="_features", labelCol="_label", predictionCol="_z", maxDepth=depth, seed=seed)
    if texts:
        shared["maxBins"] = max(32, MOST_TEXTS + 1)
    if kind == "boosted":
        learner = GBTRegressor(maxIter=rounds, stepSize=rate, lossType="squared", **shared)
    else:
        learner = RandomForestRegressor(numTrees=rounds, **shared)
    known = train.filtered(train.df.filter(F.col(train.y).isNotNull()))
    model = Pipeline(stages=[*stages, assemble, learner]).fit(whole(_pooled(known, stats)))
    rows = target.df if train.y in target.df.columns else target.df.withColumn(train.y, F.lit(0.0))
    pooled = _pooled(train.on(rows), stats)
    pooled = pooled.withColumns({"_scale": F.col("_sd"), "_middle": F.col("_mean")})
    out = model.transform(whole(pooled))
    yhat = F.col("_z") * F.col("_scale") + F.col("_middle")
    return out.select(*train.keys, F.col(train.ds).alias("ds"), yhat.alias("yhat"))


BASE_MODELS = ("forecaster", "exp_smoothing", "boosted", "forest")


def train_base_models(
    train: Series, target: Series, options: ForecastOptions = ForecastOptions(),
    models: Sequence[str] = BASE_MODELS, period: int = 30, rounds: int = 100,
) -> Series:
    """All base models trained on ``train`` and applied to ``target``, aligned on key and time.

    A long series of keys, model, ds, yhat: the input of ``predict_ensemble``. Trees take all other
    columns that both sides have. Every model answers for every row of ``target``; a model without
    an answer for a key has NULL there.
    """
    unknown = set(models) - set(BASE_MODELS)
    if unknown or not models:
        raise ValueError(f"unknown base models {sorted(unknown)}; some of {BASE_MODELS}")
    found = {}
    for name in models:
        if name == "forecaster":
            frame = target.on(target.df.select(*train.keys, train.ds, *options.regressors))
            found[name] = predict(fit(train, options), frame, options).withColumnRenamed(train.ds, "ds")
        elif name == "exp_smoothing":
            found[name] = exp_smoothing(train, target.df, period)
        else:
            found[name] = tree_model(train, target, name, rounds)
    # Fits are dear, and ensembles read the predictions several times.
    long = settled(collect_models(found, train.keys))
    bound = None if target.max_rows is None else target.max_rows
    return replace(train, df=long, keys=(*train.keys, "model"), ds="ds", y="yhat", seq=(), max_rows=bound, splits=None, layout=None)


def collect_models(models: Mapping[str, DataFrame], keys: Sequence[str] = ("key",)) -> DataFrame:
    """Long predictions of all models."""
    out = None
    for name, df in models.items():
        one = df.select(*keys, "ds", F.lit(name).alias("model"), "yhat")
        out = one if out is None else out.unionByName(one)
    return out


def wide(predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = ("key",)) -> DataFrame:
    """One column per model, aligned on key and time."""
    # One aggregation; a pivot makes two, the first of which keeps a row per model of every point.
    cols = [F.first(F.when(F.col("model") == m, F.col("yhat")), ignorenulls=True).alias(m) for m in models]
    return predictions.groupBy(*keys, "ds").agg(*cols)


# --- combination ----------------------------------------------------------------------------------------


def simple_average(predictions: DataFrame, keys: Sequence[str] = ("key",), z: float = 1.96) -> DataFrame:
    """Mean over models and ``mean +- z`` sample deviations across models."""
    return _with_interval(
        predictions.groupBy(*keys, "ds").agg(F.avg("yhat").alias("yhat"), F.stddev_samp("yhat").alias("_sd")), z
    )


def _with_interval(df: DataFrame, z: float) -> DataFrame:
    return df.withColumns(
        {"yhat_lower": F.col("yhat") - z * F.col("_sd"), "yhat_upper": F.col("yhat") + z * F.col("_sd")}
    ).drop("_sd")


def _inverse_error(error: Column, group: Sequence[str]) -> Column:
    """Weights proportional to 1/error; models without any error share all the weight."""
    w = Window.partitionBy(*group)  # the few models of one point or one key
    perfect = F.count_if(error == 0).over(w)
    inverse = F.try_divide(F.lit(1.0), error)
    exact = F.when(error == 0, 1.0 / perfect).otherwise(0.0)
    return F.when(perfect > 0, exact).otherwise(inverse / F.sum(inverse).over(w))


def dynamic_weights(
    predictions: Series, actual: DataFrame, window: int = 30
) -> DataFrame:
    """Weight of each model at each point from its mean absolute error over the rows before.

    ``predictions`` has keys, ds, model, yhat. The first ``window`` points weigh all models
    equally. A point without an actual value, such as a future one, takes the last weights before
    it, and equal ones if there are none.
    """
    keys = [k for k in predictions.keys if k != "model"]
    actual = actual.filter(F.col("y").isNotNull()).select(*keys, "ds", "y", F.lit(True).alias("_known"))
    every = predictions.df.join(actual, [*keys, "ds"], "left")
    by_model = predictions.on(every)
    if "model" not in by_model.keys:
        by_model = replace(by_model, keys=(*keys, "model"))

    if by_model.bounded and keys:
        return _weights_by_key(by_model, keys, window)

    def cols(w):
        before = w.rowsBetween(-window, -1)
        return {
            "_mae": F.avg(F.abs(F.col("yhat") - F.col("y"))).over(before),
            "_seen": F.count(F.lit(1)).over(before),
        }

    known = by_model.filtered(every.filter("_known"))
    df = windowed(known, window, cols)
    equal = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys, "ds"))
    weight = F.when(F.col("_seen") < window, equal).otherwise(_inverse_error(F.col("_mae"), [*keys, "ds"]))
    df = df.withColumn("_weight", weight).select(*by_model.df.columns, "_weight")
    later = every.filter("_known IS NULL").withColumn("_weight", F.lit(None).cast("double"))
    out = fill(by_model.filtered(df.unionByName(later)), {"weight": F.col("_weight")})
    out = out.withColumn("weight", F.coalesce("weight", equal))
    return out.select(*keys, "ds", "model", "yhat", "y", "weight")


def _weights_by_key(by_model: Series, keys: list[str], window: int) -> DataFrame:
    """Weights of bounded series: rows move to their key once, and every window after that is local.

    Rows with and without an actual value are two partitions of a model's first window. A point
    has either all or none of its rows known, so weights at a point need no further distinction.
    """
    own = [*keys, "model"]
    rows = by_model.df.repartition(*keys)
    before = Window.partitionBy(*own, "_known").orderBy(*by_model.order).rowsBetween(-window, -1)
    rows = rows.withColumns({
        "_mae": F.avg(F.abs(F.col("yhat") - F.col("y"))).over(before), "_seen": F.count(F.lit(1)).over(before),
    })
    equal = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys, "ds"))
    inverse = _inverse_error(F.col("_mae"), [*keys, "ds"])
    rows = rows.withColumns({"_equal": equal, "_inverse": inverse})
    found = F.when(F.col("_seen") < window, F.col("_equal")).otherwise(F.col("_inverse"))
    rows = rows.withColumn("_weight", F.when(F.col("_known"), found))
    upto = Window.partitionBy(*own).orderBy(*by_model.order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("weight", F.coalesce(F.last("_weight", ignorenulls=True).over(upto), "_equal"))
    return rows.select(*keys, "ds", "model", "yhat", "y", "weight")


def weighted(weights: DataFrame, keys: Sequence[str] = ("key",), z: float = 1.96) -> DataFrame:
    """Weighted forecast, with the spread across models as its interval."""
    return _with_interval(
        weights.groupBy(*keys, "ds").agg(
            F.sum(F.col("weight") * F.col("yhat")).alias("yhat"), F.stddev_samp("yhat").alias("_sd")
        ),
        z,
    )


def static_weights(joined: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """One weight per key and model from 1/RMSE over the whole validation part."""
    err = F.col("y") - F.col("yhat")
    rmse = joined.groupBy(*keys, "model").agg(F.sqrt(F.avg(err * err)).alias("rmse"))
    return rmse.withColumn("weight", _inverse_error(F.col("rmse"), keys))


def inverse_error_average(predictions: DataFrame, weights: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Forecast with static weights; one row per key and model joins the predictions."""
    return weighted(predictions.join(weights.select(*keys, "model", "weight"), [*keys, "model"]), keys)


voting = simple_average  # soft voting of regressors is their mean


def fit_stacking(
    predictions: DataFrame, models: Sequence[str], alpha: float = 1.0, keys: Sequence[str] = ("key",)
) -> DataFrame:
    """Ridge regression with intercept of y on the model columns, per key.

    ``predictions`` is wide: keys, ds, one column per model, y. Keys meet only as co-moments of
    the few models, which combine map-side; the system per key is models x models.
    """
    models, keys = list(models), list(keys)
    whole = predictions.na.drop("any", subset=[*models, "y"])
    cols = [*models, "y"]
    pairs = [(a, b) for a in models for b in cols]
    n = F.count(F.lit(1))
    stats = whole.groupBy(*keys).agg(
        F.array(*[F.covar_pop(a, b) * n for a, b in pairs]).alias("_c"),
        F.array(*[F.avg(c) for c in cols]).alias("_m"),
    )
    k = len(models)

    def solve(batches):
        for batch in batches:
            out = batch[keys].copy()
            coef, icept = [], []
            for c, m in zip(batch["_c"], batch["_m"]):
                c = np.asarray(c).reshape(k, k + 1)
                w = np.linalg.solve(c[:, :k] + alpha * np.eye(k), c[:, k])
                coef.append(w)
                icept.append(float(m[k] - np.dot(m[:k], w)))
            out["coef"], out["intercept"] = coef, icept
            yield out

    return stats.mapInPandas(solve, f"{key_schema(predictions, keys)}, coef array<double>, intercept double")


def stacked(predictions: DataFrame, meta: DataFrame, models: Sequence[str], keys: Sequence[str] = ("key",), z: float = 1.96) -> DataFrame:
    """Apply the ridge of each key; the spread across models gives the interval.

    A key without one complete row has no ridge and takes the mean of the models.
    """
    models = list(models)
    total = F.col("intercept")
    for i, m in enumerate(models):
        total = total + F.get("coef", F.lit(i)) * F.col(m)
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    squares = [F.pow(F.col(m) - mean, 2) for m in models]
    spread = F.sqrt(sum(squares[1:], squares[0]) / (len(models) - 1)) if len(models) > 1 else F.lit(None).cast("double")
    df = predictions.join(meta, list(keys), "left")
    df = df.withColumns({"yhat": F.when(F.col("coef").isNull(), mean).otherwise(total), "_sd": spread})
    return _with_interval(df, z).select(*keys, "ds", "yhat", "yhat_lower", "yhat_upper")


METHODS = ("stacking", "dynamic_weighted", "inverse_error", "voting", "simple_average")


def predict_ensemble(
    predictions: Series, method: str = "stacking", actual: DataFrame | None = None,
    models: Sequence[str] = (), window: int = 30, alpha: float = 1.0,
) -> DataFrame:
    """Combine long predictions by the named method."""
    if method not in METHODS:
        raise ValueError(f"unknown ensemble method {method!r}; one of {METHODS}")
    keys = [k for k in predictions.keys if k != "model"]
    if method in ("voting", "simple_average"):
        return simple_average(predictions.df, keys)
    if actual is None:
        raise ValueError(f"{method} needs actual values")
    if method == "dynamic_weighted":
        return weighted(dynamic_weights(predictions, actual, window), keys)
    known = predictions.df.join(actual.select(*keys, "ds", "y"), [*keys, "ds"])
    if method == "inverse_error":
        return inverse_error_average(predictions.df, static_weights(known, keys), keys)
    if not models:
        raise ValueError("stacking needs the model names")
    columns = wide(predictions.df, models, keys)
    meta = fit_stacking(columns.join(actual.select(*keys, "ds", "y"), [*keys, "ds"]), models, alpha, keys)
    return stacked(columns, meta, models, keys)

"""Fitting the forecaster for all series in one job.

The model is ``y = trend(t) * (1 + season)`` or ``y = trend(t) + season`` with a piecewise
linear or logistic trend. The estimate is the maximum a posteriori one: normal priors on
level, slope, seasonal and regressor coefficients, a Laplace prior on the slope changes
(iteratively reweighted ridge).

``fit`` takes bounded series: one task fits a key from its few thousand rows. ``fit_long`` takes
series of any length: tasks add up cross products of the design, keys meet only as matrices
of a fixed size, and small systems are solved per key. Models that are not linear in their
coefficients take damped Gauss-Newton steps, the same ones in both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.models.design import (
    DAY_US, ForecastOptions, active_seasons, changepoint_times, days, season_basis, time_scales,
    trend_basis,
)
from tidemark.plans.segments import attach, planned, settle, windowed
from tidemark.plans.series import Series, whole_keys
from tidemark.session import settled

TOLERANCE = 1e-4  # rounds end when a step lowers the cost by no larger share
LEVEL_SCALE = 5.0  # prior deviation of level and slope, in units of the scaled target
PARAM_FIELDS = (
    "growth string, mode string, t0 bigint, t1 bigint, y_scale double, floor double, cap double, "
    "trend array<double>, cps array<double>, beta array<double>, reg_mean array<double>, "
    "reg_std array<double>, reg_beta array<double>, sigma double, n bigint, status string"
)


def _solve(gram: np.ndarray, xy: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    a = gram.copy()
    a.flat[:: len(a) + 1] += penalty
    try:
        return np.linalg.solve(a, xy)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, xy, rcond=None)[0]


def _penalty(theta: np.ndarray, n_cps: int, var: float, o: ForecastOptions, n_season: int, n_reg: int):
    """Ridge weights of the current reweighting step, in units of the residual variance."""
    change = np.maximum(np.abs(theta[2 : 2 + n_cps]), 1e-6)
    return np.concatenate(
        [
            np.full(2, var / LEVEL_SCALE**2),
            var / (o.changepoint_prior_scale * change),
            np.full(n_season, var / o.seasonality_prior_scale**2),
            np.full(n_reg, var / o.holidays_prior_scale**2),
        ]
    )


def solve_additive(
    gram: np.ndarray, xy: np.ndarray, yy: float, n: float, n_cps: int, n_season: int,
    n_reg: int, o: ForecastOptions, rounds: int = 20,
) -> tuple[np.ndarray, float]:
    """Coefficients and residual deviation from cross products alone."""
    theta = np.zeros(len(xy))
    theta[2 : 2 + n_cps] = o.changepoint_prior_scale
    var = max(yy / max(n, 1.0) * 0.01, 1e-10)
    for _ in range(rounds):
        new = _solve(gram, xy, _penalty(theta, n_cps, var, o, n_season, n_reg))
        rss = max(yy - 2 * new @ xy + new @ gram @ new, 0.0)
        moved = np.max(np.abs(new - theta)) if len(new) else 0.0
        theta, var = new, max(rss / max(n, 1.0), 1e-10)
        if moved < 1e-7:
            break
    return theta, float(np.sqrt(var))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def trend_values(basis: np.ndarray, theta: np.ndarray, growth: str, cap: float) -> np.ndarray:
    z = basis @ theta
    return cap * _sigmoid(z) if growth == "logistic" else z


def linearised(
    a: np.ndarray, x: np.ndarray, y: np.ndarray, theta: np.ndarray, beta: np.ndarray,
    o: ForecastOptions, cap: float,
) -> np.ndarray:
    """Derivatives of the model by its coefficients, and in the last column the residuals."""
    line, effect = a @ theta, x @ beta
    g, slope = line, a
    if o.growth == "logistic":
        share = _sigmoid(line)
        g, slope = cap * share, a * (cap * share * (1 - share))[:, None]
    out = np.empty((len(y), a.shape[1] + x.shape[1] + 1))
    out_a, out_x = out[:, : a.shape[1]], out[:, a.shape[1] : -1]
    if o.seasonality_mode == "multiplicative":
        lift = 1 + effect
        np.multiply(slope, lift[:, None], out=out_a)
        np.multiply(x, g[:, None], out=out_x)
        out[:, -1] = y - g * lift
    else:
        out_a[:], out_x[:], out[:, -1] = slope, x, y - g - effect
    return out


def start_state(width: int) -> dict:
    """Where damped Gauss-Newton steps start: all coefficients zero, nothing accepted yet."""
    zero = np.zeros(width)
    return {
        "now": zero, "trial": zero, "penalty": zero, "products": np.zeros(0), "rss": float("inf"),
        "damping": 0.0, "growing": 2.0, "promised": 0.0, "rounds": 0, "done": False,
    }


STATE_FIELDS = (
    "now array<double>, trial array<double>, penalty array<double>, products array<double>, rss double, "
    "damping double, growing double, promised double, rounds int, done boolean"
)


def next_state(
    state: dict, products: np.ndarray, n: float, n_cps: int, n_season: int, n_reg: int, o: ForecastOptions
) -> dict:
    """Judge the trial by the cross products of its linearised design, and make the next one.

    A trial that lowers squared error plus penalty is accepted and the penalty, which stands for
    the Laplace prior by its current weights, is taken anew; otherwise the step is damped more.
    Matrices of a fixed size are all that a round needs, wherever the rows are.
    """
    now, trial, pen = (np.asarray(state[k], float) for k in ("now", "trial", "penalty"))
    width, first = len(trial), state["rounds"] == 0
    m = products.reshape(width + 1, width + 1)
    rss = float(m[width, width])
    cost, before = rss + float(pen @ trial**2), state["rss"] + float(pen @ now**2)
    damping, out = state["damping"], {**state, "rounds": state["rounds"] + 1}
    if first or cost <= before:
        moved, gain = float(np.max(np.abs(trial - now), initial=0.0)), before - cost
        out["done"] = not first and (moved < 1e-7 or gain < TOLERANCE * before)
        # How much of the gain that the linearised model promised came true decides the next damping.
        share = 1.0 if first or state["promised"] <= 0 else gain / state["promised"]
        damping = 0.0 if first else damping * max(1 / 3, 1 - (2 * share - 1) ** 3)
        weights = np.full(width, o.changepoint_prior_scale) if first else trial
        var = max(rss / max(n, 1.0) * (0.01 if first else 1.0), 1e-10)
        now, pen = trial, _penalty(weights, n_cps, var, o, n_season, n_reg)
        out |= {"now": now, "penalty": pen, "products": m.ravel(), "rss": rss, "growing": 2.0}
    else:
        m = np.asarray(state["products"], float).reshape(width + 1, width + 1)
        damping = max(damping * state["growing"], 1e-4)
        out |= {"growing": 2 * state["growing"], "done": damping > 1e8}
    gram, slope = m[:width, :width], m[:width, width] - pen * now
    damping = damping if damping > 1e-9 else 0.0
    damped = gram.copy()
    damped.flat[:: width + 1] += damping * gram.diagonal()
    step = _solve(damped, slope, pen)
    promised = float(2 * step @ slope - step @ gram @ step - pen @ step**2)
    out |= {"trial": now + step, "damping": damping, "promised": promised}
    out["done"] = bool(out["done"] or out["rounds"] >= o.sweeps)
    return out


def _fit_newton(
    a: np.ndarray, x: np.ndarray, y: np.ndarray, n_cps: int, n_season: int, n_reg: int,
    o: ForecastOptions, cap: float, start: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Trend and effects together, by damped Gauss-Newton steps on one bounded series."""
    split = a.shape[1]
    state = start_state(split + x.shape[1])
    if start is not None:
        state["trial"] = start
    while not state["done"]:
        d = linearised(a, x, y, state["trial"][:split], state["trial"][split:], o, cap)
        state = next_state(state, d.T @ d, len(y), n_cps, n_season, n_reg, o)
    return state["now"][:split], state["now"][split:], float(np.sqrt(max(state["rss"] / len(y), 1e-10)))


def design_arrays(us: np.ndarray, y: np.ndarray, regs: np.ndarray, o: ForecastOptions) -> dict:
    """All that a fit of one series needs besides its prior scales, which many fits can share."""
    keep = np.isfinite(y)
    us, y, regs = us[keep], y[keep], regs[keep]
    if len(y) < 2:
        raise ValueError("fewer than two known values")
    if not np.isfinite(regs).all():
        raise ValueError("a regressor is NULL where the target is known")
    t0, t1 = int(us[0]), int(us[-1])
    t = (us - t0) / max(t1 - t0, 1)
    day = us / DAY_US
    floor, cap = 0.0, 0.0
    scale = float(np.abs(y).max()) or 1.0
    if o.growth == "logistic":
        spread = float(np.std(y, ddof=1))
        cap = (float(y.max()) + 2 * spread - floor) / scale
    cps = changepoint_times(t, o)
    seasons = o.seasons()
    a, s = trend_basis(t, cps), season_basis(day, seasons)
    on = np.repeat(active_seasons(day, o), [2 * x.order for x in seasons]) if seasons else np.zeros(0, bool)
    s = s * on
    mean = regs.mean(axis=0) if regs.shape[1] else np.zeros(0)
    std = regs.std(axis=0) if regs.shape[1] else np.zeros(0)
    std = np.where(std > 0, std, 1.0)
    x = np.column_stack([s, (regs - mean) / std])
    target = (y - floor) / scale
    out = {
        "a": a, "x": x, "target": target, "n_season": s.shape[1], "n_reg": regs.shape[1], "cap": cap,
        "on": np.concatenate([on, np.ones(regs.shape[1], bool)]),
        "fixed": {
            "growth": o.growth, "mode": o.seasonality_mode, "t0": t0, "t1": t1, "y_scale": scale, "floor": floor,
            "cap": cap, "cps": cps, "reg_mean": mean, "reg_std": std, "n": len(y), "status": "ok",
        },
    }
    if o.growth == "linear" and o.seasonality_mode == "additive":
        d = np.column_stack([a, x])
        out["gram"], out["xy"], out["yy"] = d.T @ d, d.T @ target, float(target @ target)
    return out


def solve_arrays(d: dict, o: ForecastOptions, start: np.ndarray | None = None) -> dict:
    """Fit with the prior scales of ``o``. Steps may start where a fit with other scales ended."""
    a, x, cps, n = d["a"], d["x"], d["fixed"]["cps"], d["fixed"]["n"]
    sizes = (len(cps), d["n_season"], d["n_reg"])
    if "gram" in d:
        full, sigma = solve_additive(d["gram"], d["xy"], d["yy"], n, *sizes, o)
        theta, beta = full[: a.shape[1]], full[a.shape[1] :]
    else:
        theta, beta, sigma = _fit_newton(a, x, d["target"], *sizes, o, d["cap"], start)
    beta = np.where(d["on"], beta, 0.0)
    split = d["n_season"]
    return {**d["fixed"], "trend": theta, "beta": beta[:split], "reg_beta": beta[split:], "sigma": sigma}


def fit_arrays(us: np.ndarray, y: np.ndarray, regs: np.ndarray, o: ForecastOptions) -> dict:
    """Fit one series from its sorted times (microseconds), targets and regressor columns."""
    return solve_arrays(design_arrays(us, y, regs, o), o)


def failed(o: ForecastOptions, error: Exception) -> dict:
    empty = np.zeros(0)
    return {
        "growth": o.growth, "mode": o.seasonality_mode, "t0": None, "t1": None, "y_scale": None,
        "floor": None, "cap": None, "trend": empty, "cps": empty, "beta": empty, "reg_mean": empty,
        "reg_std": empty, "reg_beta": empty, "sigma": None, "n": None, "status": f"failed: {error}",
    }


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def narrow(s: Series, regressors: Sequence[str]) -> DataFrame:
    """Only what a fit reads: keys, microseconds, target and regressors."""
    return s.df.select(
        *s.keys,
        F.unix_micros(F.col(s.ds).cast("timestamp")).alias("us"),
        F.col(s.y).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(c) for c in regressors],
    )


def require_bounded(s: Series, what: str) -> None:
    if not s.bounded:
        raise ValueError(
            f"{what} needs a proven row bound per key: aggregate onto a time grid first "
            "(daily, make_bars), or use fit_long for the forecaster"
        )


def fit(s: Series, options: ForecastOptions = ForecastOptions()) -> DataFrame:
    """One row of fitted parameters per key; a key that cannot be fitted says why in status.

    Rows stream past in order, so a task makes tables of many keys and no data frame per key.
    """
    require_bounded(s, "fit")
    keys, regs = list(s.keys), list(options.regressors)
    place = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("us"))
    rows = narrow(s, regs).withColumn("_place", F.row_number().over(place))
    schema = f"{key_schema(s.df, keys)}, {PARAM_FIELDS}"
    return rows.mapInArrow(_fitted(keys, regs, options), schema)


FITTED_ROWS = 50_000  # rows of whole keys that a task fits at a time; a longer key makes more


def _fitted(keys: Sequence[str], regs: Sequence[str], options: ForecastOptions):
    """Parameters of whole keys, whose rows ``_place`` numbers in order of time."""
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    kinds = {name: arrow[kind] for name, kind in (f.split() for f in PARAM_FIELDS.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in whole_keys(batches, FITTED_ROWS):
            head = np.flatnonzero(rows.column("_place").to_numpy() == 1)
            us, y = rows.column("us"), rows.column("y").to_numpy().astype(float, copy=False)
            times, timed = us.fill_null(0).to_numpy(), us.is_valid().to_numpy()
            x = np.column_stack([np.zeros((len(y), 0)), *[rows.column(c).to_numpy().astype(float, copy=False) for c in regs]])
            out = []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(y)]):
                # A NULL time is no whole number.
                t = times[a:b] if timed[a:b].all() else np.where(timed[a:b], times[a:b].astype(float), np.nan)
                try:
                    out.append(fit_arrays(t, y[a:b], x[a:b], options))
                except (ValueError, np.linalg.LinAlgError) as error:
                    out.append(failed(options, error))
            found = rows.select(list(keys)).take(pa.array(head))
            for name, kind in kinds.items():
                found = found.append_column(name, pa.array([r[name] for r in out], kind, from_pandas=True))
            yield from found.to_batches()

    return run


FLUSH_KEYS = 500


def _long_scales(known: Series, options: ForecastOptions) -> DataFrame:
    """What a fit needs of a key besides its rows: scales, changepoints, which seasons are on."""
    keys, y, regs = list(known.keys), F.col(known.y).cast("double"), options.regressors
    cap = F.max(y) + 2 * F.stddev_samp(y) if options.growth == "logistic" else F.lit(0.0)
    stats = known.df.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in regs]).cast("array<double>").alias("reg_mean"),
        F.array(
            *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in regs]
        ).cast("array<double>").alias("reg_std"),
        cap.alias("cap"),
    )
    scales = time_scales(known, options).join(stats, keys).withColumn("cap", F.col("cap") / F.col("y_scale"))
    choices = {"yearly": options.yearly, "weekly": options.weekly, "daily": options.daily}
    step = F.lit(None).cast("double")
    if "auto" in choices.values():
        gap = lambda w: {"_gap": days(F.col(known.ds)) - F.lag(days(F.col(known.ds))).over(w)}
        scales = scales.join(windowed(known, 1, gap).groupBy(*keys).agg(F.min("_gap").alias("_step")), keys)
        step = F.col("_step")
    span = (F.col("t1") - F.col("t0")) / F.lit(float(DAY_US))
    rules = {"yearly": span >= 730, "weekly": (span >= 14) & (step < 7), "daily": (span >= 2) & (step < 1)}
    on = [
        F.coalesce(rules[x.name], F.lit(False)).cast("double")
        if choices.get(x.name) == "auto" and x not in options.custom else F.lit(1.0)
        for x in options.seasons()
    ]
    return scales.withColumn("on", F.array(*on).cast("array<double>")).drop("_step")


def fit_long(s: Series, options: ForecastOptions) -> DataFrame:
    """Models of series of any length, from cross products of their design.

    A task keeps one matrix per key it meets and hands on at most ``FLUSH_KEYS`` at a time. The
    matrices of a key are summed with partial aggregation, so a hot key costs its number of
    tasks, not its rows. An additive, linear model takes one such pass. The others take one per
    round of Gauss-Newton steps: keys that are not done join their rows with the current trial,
    and what comes back is the products of the design linearised there.
    """
    keys, regs = list(s.keys), list(options.regressors)
    finite = F.col(s.y).isNotNull() & (F.abs(F.col(s.y).cast("double")) < float("inf"))
    known = settle(planned(s.filtered(s.df.where(finite))))
    scales = settled(_long_scales(known, options))
    seasons = options.seasons()
    widths = [2 * x.order for x in seasons]
    n_trend, n_season, n_reg = 2 + options.changepoints, sum(widths), len(regs)
    width = n_trend + n_season + n_reg
    names = key_schema(s.df, keys)
    linear = options.growth == "linear" and options.seasonality_mode == "additive"
    # Rows of one time and equal regressors share their row of the design: they meet as a weight, a mean
    # and squares about it before the rounds, so that no round pays for them again.
    rows = known.df.select(
        *keys, F.unix_micros(F.col(s.ds).cast("timestamp")).alias("_us"), F.col(s.y).cast("double").alias("_y"),
        *[F.col(c).cast("double").alias(f"_r{i}") for i, c in enumerate(regs)],
    ).groupBy(*keys, "_us", *[f"_r{i}" for i in range(n_reg)]).agg(
        F.count(F.lit(1)).alias("_w"), F.avg("_y").alias("_y"), (F.var_pop("_y") * F.count(F.lit(1))).alias("_within")
    )
    rows = known.reordered(settled(rows), "_us", max_rows=known.max_rows)

    def products(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            frame = pd.DataFrame(list(held), columns=keys)
            # A NULL regressor or a trial out of range makes NaN, which no vector holds; it shows as infinite.
            frame["products"] = [np.nan_to_num(m, nan=np.inf, posinf=np.inf, neginf=-np.inf).ravel() for m in held.values()]
            held.clear()
            return frame

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                head = part.iloc[0]
                us = part["_us"].to_numpy()
                t = (us - head["t0"]) / max(head["t1"] - head["t0"], 1)
                cps = np.asarray(head["cps"], float)
                a = trend_basis(t, np.concatenate([cps, np.full(options.changepoints - len(cps), np.inf)]))
                x = season_basis(us / DAY_US, seasons) * np.repeat(np.asarray(head["on"], float), widths)
                if regs:
                    z = part[[f"_r{i}" for i in range(n_reg)]].to_numpy(float)
                    x = np.column_stack([x, (z - np.asarray(head["reg_mean"])) / np.asarray(head["reg_std"])])
                trial = np.asarray(head["trial"], float)
                with np.errstate(over="ignore", invalid="ignore"):
                    d = linearised(a, x, part["_y"].to_numpy() / head["y_scale"], trial[:n_trend], trial[n_trend:], options, head["cap"])
                    m = (d * part["_w"].to_numpy(float)[:, None]).T @ d
                    m[-1, -1] += part["_within"].sum() / head["y_scale"] ** 2
                    held[key] = held.get(key, 0.0) + m
            if len(held) >= FLUSH_KEYS:
                yield flush()
        if held:
            yield flush()

    def measured(state: DataFrame) -> DataFrame:
        """Summed products of every key of ``state`` at its trial."""
        wanted = scales.join(state.select(*keys, "trial"), keys).select(
            *keys, "t0", "t1", "y_scale", "cps", "reg_mean", "reg_std", "cap", "on", "trial"
        )
        parts = attach(rows, wanted).where("trial IS NOT NULL")
        parts = parts.mapInPandas(products, f"{names}, products array<double>")
        return parts.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("measured"))

    def judge(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                m = np.asarray(row["measured"], float)
                state = {k: row[k] for k in start_state(0)}
                if state["rounds"] == 0 and not np.isfinite(m).all():
                    state |= {"done": True, "products": m}  # a NULL regressor: reported as failed below
                elif linear:
                    g = m.reshape(width + 1, width + 1)
                    theta, sigma = solve_additive(
                        g[:width, :width], g[:width, width], g[width, width], row["n"], options.changepoints, n_season, n_reg, options
                    )
                    state |= {"done": True, "now": theta, "rss": sigma**2 * row["n"]}
                else:
                    state = next_state(state, m, row["n"], options.changepoints, n_season, n_reg, options)
                out.append({**{k: row[k] for k in keys}, "n": row["n"], **state})
            yield pd.DataFrame(out)

    def literal(v):
        if isinstance(v, np.ndarray):
            return F.array(*[F.lit(float(e)) for e in v]).cast("array<double>")
        return F.lit(v)

    fresh = {k: literal(v) for k, v in start_state(width).items()}
    state = settled(scales.select(*keys, "n", *[v.alias(k) for k, v in fresh.items()]))
    for _ in range(options.sweeps):
        active = state.where("NOT done")
        if active.isEmpty():
            break
        moved = active.join(measured(active), keys).mapInPandas(judge, f"{names}, n bigint, {STATE_FIELDS}")
        state = settled(state.where("done").unionByName(moved))

    def finish(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = {k: row[k] for k in keys}
                if row["n"] is None or not row["n"] >= 2:
                    out.append({**key, **failed(options, ValueError("fewer than two known values"))})
                    continue
                if row["products"] is not None and not np.isfinite(np.asarray(row["products"], float)).all():
                    out.append({**key, **failed(options, ValueError("a regressor is NULL where the target is known"))})
                    continue
                now, split = np.asarray(row["now"], float), 2 + len(row["cps"])
                on = np.repeat(np.asarray(row["on"], float), widths)
                out.append(
                    {
                        **key, "growth": options.growth, "mode": options.seasonality_mode, "t0": int(row["t0"]),
                        "t1": int(row["t1"]), "y_scale": row["y_scale"], "floor": 0.0, "cap": row["cap"],
                        "trend": now[:split], "cps": row["cps"], "beta": now[n_trend : n_trend + n_season] * on,
                        "reg_mean": row["reg_mean"], "reg_std": row["reg_std"], "reg_beta": now[n_trend + n_season :],
                        "sigma": float(np.sqrt(max(row["rss"] / row["n"], 1e-10))), "n": int(row["n"]), "status": "ok",
                    }
                )
            yield pd.DataFrame(out)

    found = state.select(*keys, "n", "now", "products", "rss").join(scales.drop("n"), keys)
    every = s.df.select(*keys).distinct()
    return every.join(found, keys, "left").mapInPandas(finish, f"{names}, {PARAM_FIELDS}")

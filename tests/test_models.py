"""Forecaster recovery, agreement of its two designs and fits, tuning, ensembles, versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.models import cv, design, ensemble, tune
from tidemark.models.fit import fit, fit_arrays, fit_long
from tidemark.models.predict import predict, simulate_deviation
from tidemark.operators import metrics
from tidemark.plans.series import series
from tidemark.plans.workflow import WorkflowConfig, run_workflow
from tidemark.sources.versions import VersionStore

N = 800
DAY = np.arange(N) + 19000


def truth(kind: str) -> np.ndarray:
    trend = 50 + 0.05 * np.arange(N) + 0.15 * np.maximum(np.arange(N) - 400, 0)
    week = np.sin(2 * np.pi * DAY / 7)
    year = np.cos(2 * np.pi * DAY / 365.25)
    if kind == "multiplicative":
        return trend * (1 + 0.08 * week + 0.15 * year)
    return trend + 4 * week + 8 * year


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    parts = []
    for key in ("additive", "multiplicative"):
        clean = truth(key)
        parts.append(pd.DataFrame({"key": key, "d": DAY, "clean": clean, "y": clean + rng.normal(0, 1.5, N)}))
    df = spark.createDataFrame(pd.concat(parts)).selectExpr("key", "timestamp_seconds(d * 86400) AS ds", "y", "clean")
    return series(df.persist(), max_rows=N)


def only(s, key):
    return s.filtered(s.df.filter(F.col("key") == key))


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_recovers_trend_and_season(world, mode):
    o = design.ForecastOptions(seasonality_mode=mode)
    s = only(world, mode)
    got = predict(fit(s, o), s, o).join(s.df.select("key", "ds", "y", "clean"), ["key", "ds"]).toPandas()
    assert np.sqrt(np.mean((got.yhat - got.clean) ** 2)) < 0.8
    assert (got.yhat_lower <= got.yhat).all() and (got.yhat <= got.yhat_upper).all()
    cover = got.y.between(got.yhat_lower, got.yhat_upper).mean()
    assert 0.9 < cover < 0.99


def test_logistic_stays_below_its_cap(world):
    o = design.logistic_options()
    p = fit(world, o)
    got = predict(p, world, o).join(world.df.select("key", "ds", "y", "clean"), ["key", "ds"]).toPandas()
    assert np.sqrt(np.mean((got.yhat - got.clean) ** 2)) < 3
    caps = {r["key"]: r["cap"] * r["y_scale"] for r in p.collect()}
    assert (got.trend <= got.key.map(caps) + 1e-6).all()


@pytest.mark.parametrize("growth", ["linear", "logistic"])
@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_long_fit_equals_grouped_fit(world, growth, mode):
    o = design.ForecastOptions(growth=growth, seasonality_mode=mode, daily="auto", changepoints=10)
    holes = world.df.withColumn("y", F.when(F.dayofmonth("ds") != 3, F.col("y")))
    grouped = {r["key"]: r for r in fit(series(holes, max_rows=N), o).collect()}
    rows = fit_long(series(holes, segment_rows=200), o).collect()
    assert len(rows) == len(grouped) == 2
    for r in rows:
        g = grouped[r["key"]]
        assert (r["status"], r["n"], r["mode"], r["growth"]) == ("ok", g["n"], mode, growth)
        np.testing.assert_allclose(r["cps"], g["cps"], atol=1e-12)
        np.testing.assert_allclose(r["trend"], g["trend"], atol=1e-4)
        np.testing.assert_allclose(r["beta"], g["beta"], atol=1e-5)
        assert r["cap"] == pytest.approx(g["cap"]) and r["sigma"] == pytest.approx(g["sigma"], rel=1e-4)
    with pytest.raises(ValueError):
        fit(series(holes, segment_rows=200), o)


def test_long_fit_reports_what_it_cannot_fit(spark):
    rows = [("ok", i, float(i % 7) + 1, 1.0 * i) for i in range(60)] + [("one", 1, 5.0, 1.0), ("none", 1, None, 1.0), ("none", 2, None, 2.0)]
    rows += [("gap", i, float(i), None if i == 7 else 1.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, i int, y double, x double").selectExpr("key", "timestamp_seconds(i * 86400) AS ds", "y", "x")
    o = design.ForecastOptions(yearly=False, daily=False, regressors=("x",))
    got = {r["key"]: r["status"] for r in fit_long(series(df, segment_rows=20), o).collect()}
    assert got.pop("ok") == "ok"
    assert got == {"one": "failed: fewer than two known values", "none": "failed: fewer than two known values",
                   "gap": "failed: a regressor is NULL where the target is known"}


def test_prior_scales_share_designs(world):
    """Sets fitted one after the other on one design equal fits of their own."""
    pdf = rows_of(only(world, "multiplicative").df)
    us = (DAY * 86_400_000_000).astype(np.int64)
    x, y = np.zeros((N, 0)), pdf.y.to_numpy()
    train = np.arange(N) < 700
    grid = {"changepoint_prior_scale": (0.01, 0.5), "seasonality_mode": ("additive", "multiplicative"), "holidays_prior_scale": (0.1, 10.0)}
    sets = [design.ForecastOptions(samples=20).with_params(p) for p in tune.grid_rows(grid)]
    for param_id, (yhat, low, high) in tune._fold(us, y, x, train, ~train, sets, 1):
        p = fit_arrays(us[train], y[train], x[train], sets[param_id])
        alone, _, _ = tune.forecast_arrays(p, us[~train], x[~train], sets[param_id], 1)
        np.testing.assert_allclose(yhat, alone, rtol=0.02)
        assert (low <= yhat).all() and (yhat <= high).all()


def test_column_forecast_equals_array_forecast(world):
    o = design.ForecastOptions(custom=(design.Season("monthly", 30.5, 3),))
    s = only(world, "multiplicative")
    pdf = rows_of(s.df)
    us = (pdf.ds.astype("int64") // 1000).to_numpy() if str(pdf.ds.dtype) == "datetime64[ns]" else pdf.ds.astype("int64").to_numpy()
    p = fit_arrays(us, pdf.y.to_numpy(), np.zeros((N, 0)), o)
    yhat, _, _ = tune.forecast_arrays(p, us, np.zeros((N, 0)), o, 1)
    got = rows_of(predict(fit(s, o), s, o))
    np.testing.assert_allclose(got["yhat"], yhat, rtol=1e-9)
    assert "monthly" in got.columns


def test_design_columns_equal_arrays(world):
    s = only(world, "additive")
    out = rows_of(design.design_matrix(s, design.time_scales(s)))
    t = (DAY - DAY[0]) / (DAY[-1] - DAY[0])
    cps = design.changepoint_times(t, design.ForecastOptions())
    np.testing.assert_allclose(np.stack(out["hinges"]), design.trend_basis(t, cps)[:, 2:], atol=1e-9)
    waves = design.season_basis(DAY.astype(float), design.ForecastOptions().seasons())
    names = [c for c in out.columns if "_sin_" in c or "_cos_" in c]
    np.testing.assert_allclose(out[names].to_numpy(), waves, atol=1e-9)


def test_auto_seasons():
    o = design.ForecastOptions(yearly="auto", weekly="auto", daily="auto")
    assert design.active_seasons(np.arange(100.0), o) == [False, True, False]
    assert design.active_seasons(np.arange(800.0), o) == [True, True, False]
    assert design.active_seasons(np.arange(0, 5, 1 / 24), o) == [False, False, True]
    assert [x.order for x in design.ForecastOptions(yearly=4, weekly=False).seasons()] == [4, 4]


def test_interval_widens_and_ignores_batching():
    t = np.linspace(1.01, 1.5, 20)
    low, high = simulate_deviation(t, 25, 0.3, 0.05, np.ones(20), 400, 0.95, 9)
    assert (np.diff(high - low) > -0.02).all() and high[-1] > high[0]
    part = simulate_deviation(t[:7], 25, 0.3, 0.05, np.ones(7), 400, 0.95, 9)
    np.testing.assert_allclose(part[0], low[:7])


def test_interval_covers_a_simulated_world():
    """Worlds whose slope changes as the model assumes stay inside 95 % intervals 95 % of the time."""
    rate, change, sigma, worlds = 20.0, 0.2, 0.03, 4000
    t = np.array([1.05, 1.2, 1.5])
    rng = np.random.default_rng(17)
    inside = np.zeros(len(t))
    for w in range(worlds):
        number = rng.poisson(rate * 0.5)
        at, size = 1 + 0.5 * rng.random(number), rng.laplace(0, change, number)
        truth = (size[:, None] * np.maximum(t - at[:, None], 0)).sum(axis=0) + rng.normal(0, sigma, len(t))
        if w % 100 == 0:  # intervals of forty seeds
            low, high = simulate_deviation(t, rate, change, sigma, np.ones(len(t)), design.ForecastOptions().samples, 0.95, w)
        inside += (low <= truth) & (truth <= high)
    assert np.abs(inside / worlds - 0.95).max() < 0.02


def test_regressor_helps_and_is_carried(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 300)
    pdf = pd.DataFrame({"key": "k", "d": np.arange(300) + 19000, "x": x, "y": 20 + 5 * x + rng.normal(0, 0.2, 300)})
    df = spark.createDataFrame(pdf).selectExpr("key", "timestamp_seconds(d * 86400) AS ds", "y", "x")
    s = series(df, max_rows=300)
    o = design.ForecastOptions(seasonality_mode="additive", yearly=False, regressors=("x",))
    p = fit(s, o)
    got = rows_of(predict(p, s, o))
    assert np.sqrt(np.mean((got.yhat - pdf.y) ** 2)) < 0.4
    ahead = cv.carry_regressors(s, cv.future_frame(s, 5, include_history=False), ["x"])
    assert set(ahead.toPandas()["x"]) == {x[-1]}
    assert predict(p, s.reordered(ahead, "ds", max_rows=5), o).filter("yhat IS NOT NULL").count() == 5


def test_failed_fit_is_reported(make):
    s = make({"one": [3.0], "k": [float(i) for i in range(30)]})
    got = {r["key"]: r["status"] for r in fit(s).collect()}
    assert got["k"] == "ok" and got["one"].startswith("failed")
    # The failed key's rows stay, without a forecast.
    rows = rows_of(predict(fit(s), s))
    assert set(rows[rows.yhat.notna()].key) == {"k"} and len(rows) == 31


# --- cross-validation and tuning ---


def loop_cutoffs(ds, initial, period, horizon):
    """The rule as a loop over timestamps."""
    cut = ds.max() - horizon
    out = [cut]
    while out[-1] >= ds.min() + initial:
        cut = cut - period
        if not ((ds > cut) & (ds <= cut + horizon)).any() and cut > ds.min():
            cut = ds[ds <= cut].max() - horizon
        out.append(cut)
    return sorted(out[:-1])


def test_cutoffs_over_random_gaps(spark):
    rng = np.random.default_rng(12)
    frames, expected = [], {}
    for i in range(25):
        days = np.sort(rng.choice(500, rng.integers(8, 60), replace=False))
        ds = pd.Series(pd.to_datetime("2020-01-01") + pd.to_timedelta(days, unit="D"))
        frames.append(pd.DataFrame({"key": f"k{i}", "ds": ds, "y": 1.0}))
        expected[f"k{i}"] = loop_cutoffs(ds, *(pd.Timedelta(days=x) for x in (100, 15, 20)))
    s = series(spark.createDataFrame(pd.concat(frames)), max_rows=60)
    got = cv.cv_cutoffs(s, "100 days", "15 days", "20 days").toPandas()
    for key, cuts in expected.items():
        assert sorted(got[got.key == key]["cutoff"]) == cuts, key


def test_folds_do_not_leak(world):
    cuts = cv.cv_cutoffs(world, "400 days", "100 days", "30 days")
    got = cv.folds(world, cuts).toPandas()
    assert (got[got.is_train].ds <= got[got.is_train].cutoff).all()
    test = got[~got.is_train]
    assert ((test.ds > test.cutoff) & (test.ds <= test.cutoff + pd.Timedelta(days=30))).all()


def test_grid_search_takes_the_least_error(world):
    cuts = cv.cv_cutoffs(world, "500 days", "60 days", "30 days")
    grid = {"seasonality_mode": ("additive", "multiplicative"), "changepoint_prior_scale": (0.05,)}
    scores, best = tune.grid_search(world, cuts, grid)
    assert scores.count() == 4
    table = scores.toPandas()
    least = table.loc[table.groupby("key").rmse.idxmin()].set_index("key").seasonality_mode
    got = {r["key"]: r["seasonality_mode"] for r in best.collect()}
    assert got == least.to_dict()
    assert {r["key"]: r["mode"] for r in tune.fit_best(world, best, grid).collect()} == got
    imp = metrics.param_importance(scores, list(grid), keys=["key"]).toPandas()
    np.testing.assert_allclose(imp.groupby("key").importance.sum(), 1.0)


def test_failed_sets_are_skipped(make):
    s = make({"short": [1.0, 2.0, 3.0], "k": [float(i % 7) for i in range(60)]})
    cuts = cv.backtest_cutoffs(s, 1, "2 days")
    got = tune.cross_validate(s, cuts, grid={"changepoint_prior_scale": (0.05, 0.5)}).toPandas()
    assert got[got.key == "short"].error.notna().all() and got[got.key == "k"].error.isna().all()
    _, best = tune.grid_search(s, cuts, {"changepoint_prior_scale": (0.05, 0.5)})
    assert {r["key"]: r["param_id"] for r in best.collect()}["short"] == -1


def test_grid_sizes(spark):
    assert cv.param_grid(spark).count() == 512
    assert cv.param_grid(spark, cv.TRAINER_GRID).count() == 64


# --- ensembles ---


def test_weights(spark, make):
    n = 60
    y = np.arange(n) + 10.0
    rows = [("k", i, m, float(v)) for i in range(n) for m, v in (("perfect", y[i]), ("off", y[i] + 1), ("far", y[i] - 3))]
    df = spark.createDataFrame(rows, "key string, i int, model string, yhat double").selectExpr("key", "timestamp_seconds(i * 86400) AS ds", "model", "yhat")
    actual = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "key string, i int, y double").selectExpr("key", "timestamp_seconds(i * 86400) AS ds", "y")
    s = series(df, keys=("key", "model"), y="yhat", max_rows=n)
    w = ensemble.dynamic_weights(s, actual).toPandas()
    np.testing.assert_allclose(w.groupby("ds").weight.sum(), 1.0)
    late = w[w.ds >= pd.Timestamp("1970-02-05")]
    assert (late[late.model == "perfect"].weight == 1).all()
    two = s.on(df.filter("model <> 'perfect'"))
    w = ensemble.dynamic_weights(two, actual).toPandas()
    late = w[w.ds >= pd.Timestamp("1970-02-05")]
    np.testing.assert_allclose(late[late.model == "off"].weight, 0.75)
    known = df.join(actual, ["key", "ds"])
    static = {r["model"]: r["weight"] for r in ensemble.static_weights(known).collect()}
    assert static["perfect"] == 1.0 and static["far"] == 0.0
    avg = rows_of(ensemble.predict_ensemble(s, "voting"))
    np.testing.assert_allclose(avg["yhat"], y - 2 / 3)
    with pytest.raises(ValueError):
        ensemble.predict_ensemble(s, "loud")


def test_stacking_is_ridge(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (80, 3))
    y = x @ [0.5, 0.3, 0.2] + 4 + rng.normal(0, 0.1, 80)
    pdf = pd.DataFrame({"key": "k", "i": range(80), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    df = spark.createDataFrame(pdf).withColumn("ds", F.timestamp_seconds("i"))
    got = ensemble.fit_stacking(df, ["a", "b", "c"]).first()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(got["coef"], w, atol=1e-9)
    assert got["intercept"] == pytest.approx(y.mean() - x.mean(0) @ w)


def test_smoothing_follows_a_season():
    t = np.arange(240)
    y = 10 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 30)
    ahead = np.arange(240, 270)
    exp = 10 + 0.1 * ahead + 3 * np.sin(2 * np.pi * ahead / 30)
    assert np.sqrt(np.mean((ensemble.smooth_arrays(y, 30) - exp) ** 2)) < 0.6
    with pytest.raises(ValueError):
        ensemble.smooth_arrays(y[:50], 5)


def test_smoothing_in_segments_equals_the_recursion(spark):
    rng = np.random.default_rng(5)
    n = 1500
    y = 20 + 0.05 * np.arange(n) + 4 * np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(0, 1, n)
    rows = [("long", i, float(v)) for i, v in enumerate(y)] + [("long", n, None), ("short", 0, 1.0), ("mid", 1, None)]
    rows += [("mid", i + 2, float(v)) for i, v in enumerate(y[:100])]
    df = spark.createDataFrame(rows, "key string, i int, y double").selectExpr("key", "timestamp_seconds(i) AS ds", "y")
    target = spark.createDataFrame([(k, i) for k in ("long", "mid", "short", "new") for i in range(5000, 5020)], "key string, i int")
    target = target.selectExpr("key", "timestamp_seconds(i) AS ds")
    got = rows_of(ensemble.exp_smoothing(series(df, segment_rows=200), target, period=12))
    for key, values in (("long", y), ("mid", y[:100])):
        part = got[got.key == key]
        np.testing.assert_allclose(part.yhat, ensemble.smooth_arrays(values, 20, 12), rtol=1e-9)
        assert set(part.status) == {"ok"}
    assert got[got.key.isin(["short", "new"])].yhat.isna().all() and len(got) == 80
    assert set(got[got.key == "short"].status) == {"needs 24 rows, got 1"}
    whole = rows_of(ensemble.exp_smoothing(series(df, max_rows=n + 1), target, period=12))
    np.testing.assert_allclose(got.yhat, whole.yhat, rtol=1e-9)


def test_tree_models(world):
    s = world.on(world.df.drop("clean"))
    train = s.filtered(s.df.filter("ds < '2023-06-01'"))
    test = s.filtered(s.df.filter("ds >= '2023-06-01'"))
    for kind in ("boosted", "forest"):
        # Trees cannot follow a trend out of its range, so the error is measured inside it.
        ahead = ensemble.tree_model(train, test, kind, rounds=5)
        assert metrics.with_actual(ahead, test.df).filter("yhat IS NOT NULL").count() == test.df.count()
        inside = metrics.with_actual(ensemble.tree_model(train, train, kind, rounds=5), train.df)
        spread = train.df.groupBy("key").agg(F.stddev_pop("y").alias("sd"))
        assert metrics.evaluate_forecast(inside).join(spread, "key").filter("rmse < 0.6 * sd").count() == 2


def test_base_models_in_one_call(world):
    """Trees take the other columns: text, and numbers with gaps."""
    late = F.when(F.dayofweek("ds") > 4, "late").otherwise("early")
    s = world.on(world.df.drop("clean").withColumns({"part": late, "x": F.when(F.dayofmonth("ds") > 2, F.dayofmonth("ds"))}))
    train = s.filtered(s.df.filter("ds < '2023-06-01'"))
    test = s.filtered(s.df.filter("ds >= '2023-06-01'"))
    assert ensemble.tree_features(train, test.df) == ["x", "part"]
    out = ensemble.train_base_models(train, test, rounds=3)
    assert out.keys == ("key", "model")
    counts = {r["model"]: (r["n"], r["known"]) for r in out.df.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("yhat").alias("known")).collect()}
    n = test.df.count()
    assert counts == {m: (n, n) for m in ensemble.BASE_MODELS}
    assert ensemble.predict_ensemble(out, "simple_average").count() == n
    with pytest.raises(ValueError):
        ensemble.train_base_models(train, test, models=("loud",))


# --- versions and workflow ---


def test_version_store(spark, make, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    s = make({"k": [1.0, 2.0]})
    assert store.latest("data", "interim", "cleaned_data") is None
    with pytest.raises(FileNotFoundError):
        store.load("data", "interim", "cleaned_data")
    ids = [store.save(s.df.withColumn("v", F.lit(i)), "data", "interim", "cleaned_data", {"i": i}) for i in range(4)]
    assert store.versions("data", "interim") == ids
    assert store.load("data", "interim", "cleaned_data").first()["v"] == 3
    assert store.load("data", "interim", version=ids[1]).first()["v"] == 1
    assert store.metadata("data", "interim", version=ids[2]) == {"i": 2}
    assert store.expire("data", "interim", keep_last=2) == 2
    assert store.versions("data", "interim") == ids[2:]
    assert store.save(s.df, "data", "interim", "cleaned_data").endswith("_v005")
    assert store.load_latest_features().count() == 2
    store.save(s.df.withColumn("SMA", F.lit(1.0)), "data", "interim", "technical_indicators")
    assert "SMA" in store.load_latest_features().columns
    assert store.save_features(s.df, "lag").startswith("lag_features")
    with pytest.raises(ValueError):
        store.save_features(s.df, "other")


def test_model_round_trip(spark, world, tmp_path):
    store = VersionStore(spark, str(tmp_path / "models"))
    p = fit(world)
    store.save_model(p, metadata={"kind": "forecaster"})
    a, b = rows_of(predict(p, world)), rows_of(predict(store.load_model(), world))
    np.testing.assert_allclose(a["yhat"], b["yhat"])


def test_workflow(world):
    s = world.on(world.df.drop("clean"))
    out = run_workflow(s, WorkflowConfig(periods=30, cross_validate=True, initial="500 days", period="60 days", horizon="30 days", options=design.ForecastOptions(samples=50)))
    m = out["metrics"].toPandas()
    assert (m[["rmse", "mae"]] >= 0).all().all() and len(m) == 2
    assert out["summary"].filter("periods = 30").count() == 2
    f = out["forecast"].toPandas()
    assert f.yhat.notna().all() and (f.yhat_lower <= f.yhat_upper).all()
    assert out["cv_metrics"].filter("rmse >= 0").count() > 0
    assert out["features"].filter("is_train").count() > 0
    # The features are the model's regressors.
    assert out["params"].filter("size(reg_beta) > 5 AND status = 'ok'").count() == 2
    assert out["nulls_after"].filter("nulls > 0").count() == 0

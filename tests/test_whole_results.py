"""No rows, keys or years lost: ranges from the data, any holiday, every key and point answered."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.functions.calendar import add_holiday, holiday_table
from tidemark.models import design, ensemble
from tidemark.models.fit import fit, fit_long
from tidemark.models.predict import predict
from tidemark.operators import clean, indicators, metrics, reduce
from tidemark.operators.enrich import as_of
from tidemark.operators.profile import correlated_columns, pairwise_correlations
from tidemark.plans.series import series
from tidemark.sources import bars


def day(text):
    return pd.Timestamp(text).to_pydatetime()


def test_bars_and_days_of_any_year(spark):
    rows = [("a", day("1960-03-01 10:00"), 1.0), ("a", day("2045-07-02 11:30"), 2.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, price double")
    s = bars.make_bars(df, interval="1d")
    assert s.df.count() == 2 and s.max_rows >= 31_000
    d = bars.daily(df, F.col("key"), "ts", F.sum("price"))
    assert d.df.count() == 2
    assert bars.daily(df.limit(0), F.col("key"), "ts", F.sum("price")).df.count() == 0
    assert bars.resample_bars(s, "1mo").df.count() == 2


def test_holidays_need_no_table(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1985-12-01', DATE'2046-02-01', INTERVAL 1 DAY)) AS ds")
    got = {str(r["ds"]) for r in add_holiday(days).filter("is_holiday = 1").collect()}
    want = {str(r["date"]) for r in holiday_table(spark, 1985, 2046).collect() if "1985-12-01" <= str(r["date"]) <= "2046-02-01"}
    assert got == want and {"1989-12-25", "2040-12-25"} <= got
    nothing = spark.createDataFrame([(None,)], "ds timestamp")
    assert add_holiday(nothing).first()["is_holiday"] == 0


def test_future_points_take_the_last_weights(spark):
    rows = [("k", day("2024-01-01") + pd.Timedelta(days=i), m, float(i + e)) for i in range(60) for m, e in (("a", 1), ("b", 3))]
    long = spark.createDataFrame(rows, "key string, ds timestamp, model string, yhat double")
    actual = spark.createDataFrame([(k, d, y - 1) for k, d, m, y in rows[:80] if m == "a"], "key string, ds timestamp, y double")
    s = series(long, ("key", "model"), "ds", "yhat", max_rows=60)
    w = rows_of(ensemble.dynamic_weights(s, actual), "ds", "model")
    assert len(w) == 120 and w.weight.notna().all()
    np.testing.assert_allclose(w[w.model == "a"].weight.iloc[39:], 0.75)
    for method in ("dynamic_weighted", "inverse_error", "stacking", "simple_average"):
        out = ensemble.predict_ensemble(s, method, actual, ["a", "b"])
        assert out.filter("yhat IS NOT NULL").count() == 60


def test_short_keys_say_so(spark):
    rows = [(k, day("2024-01-01") + pd.Timedelta(days=i), float(i)) for k, n in (("long", 90), ("short", 40)) for i in range(n)]
    train = series(spark.createDataFrame(rows, "key string, ds timestamp, y double"), max_rows=90)
    ahead = [(k, day("2024-06-01") + pd.Timedelta(days=i)) for k in ("long", "short", "new") for i in range(5)]
    out = rows_of(ensemble.exp_smoothing(train, spark.createDataFrame(ahead, "key string, ds timestamp")))
    assert len(out) == 15
    assert set(out[out.yhat.isna()].key) == {"short", "new"} and out[out.key == "short"].status.iloc[0].endswith("got 40")


def test_failed_keys_stay_in_forecasts(spark):
    rows = [(k, day("2024-01-01") + pd.Timedelta(days=i), float(i)) for k, n in (("a", 60), ("one", 1)) for i in range(n)]
    s = series(spark.createDataFrame(rows, "key string, ds timestamp, y double"), max_rows=60)
    out = rows_of(predict(fit(s), s))
    assert len(out) == 61 and out[out.key == "one"].yhat.isna().all() and out[out.key == "a"].yhat_lower.notna().all()


@pytest.mark.parametrize("fitting", [fit, fit_long])
def test_null_regressors_fail_a_key(spark, fitting):
    rows = [(k, day("2024-01-01") + pd.Timedelta(days=i), float(i), None if k == "bad" and i == 7 else float(i % 5)) for k in ("bad", "good") for i in range(80)]
    s = series(spark.createDataFrame(rows, "key string, ds timestamp, y double, x double"), max_rows=80)
    options = design.ForecastOptions(seasonality_mode="additive", regressors=("x",), samples=20)
    got = {r["key"]: r["status"] for r in fitting(s, options).collect()}
    assert got["good"] == "ok" and "regressor" in got["bad"]


def test_trees_keep_rows_with_nulls_and_new_keys(spark):
    rows = [(k, day("2024-01-01") + pd.Timedelta(days=i), float(i % 7), None if i % 3 else 1.0) for k in ("a", "b") for i in range(60)]
    s = series(spark.createDataFrame(rows, "key string, ds timestamp, y double, x double"), max_rows=60)
    target = s.on(s.df.withColumn("key", F.when(F.col("key") == "b", F.lit("new")).otherwise(F.col("key"))))
    out = rows_of(ensemble.tree_model(s, target, "forest", rounds=3, features=("x",)))
    assert len(out) == 120 and out[out.key == "new"].yhat.isna().all() and out[out.key == "a"].yhat.notna().all()


def test_correlation_over_known_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) + 1e6
    table = pd.DataFrame({"a": x[:, 0], "b": 2 * x[:, 0], "c": x[:, 1], "d": x[:, 2], "e": 5.0})
    table.loc[::3, "c"] = None
    table.loc[1::3, "d"] = None
    df = spark.createDataFrame(table).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in table]).withColumn("none", F.lit(None).cast("double"))
    cols = [*table, "none"]
    assert correlated_columns(df, cols) == ["b"]
    r = pairwise_correlations(df, cols)
    np.testing.assert_allclose(r[:4, :4], table[["a", "b", "c", "d"]].corr().to_numpy(), atol=1e-6)
    assert np.isnan(r[4]).all() and np.isnan(r[5]).all()


def test_winsorize_leaves_keys_without_outliers(make):
    calm = [float(i % 5) for i in range(100)]
    s = make({"calm": calm, "wild": [*calm[:-1], 1e6]})
    out = rows_of(clean.handle_outliers(s, "zscore", "winsorize").df)
    assert out[out.key == "calm"].y.tolist() == calm
    assert out[out.key == "wild"].y.max() < 1e6


def test_shared_as_of_over_many_keys(make, spark):
    s = make({k: [1.0, 2.0, 3.0, 4.0] for k in "abc"})
    other = spark.createDataFrame([(day("2024-01-02"), 7.0), (day("2024-01-03 12:00"), 8.0)], "ds timestamp, z double")
    out = as_of(s, other, ["z"])
    got = rows_of(out)
    assert [None if pd.isna(v) else v for v in got[got.key == "c"].z] == [None, 7.0, 7.0, 8.0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_overall_metrics_by_other_keys(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0), ("b", "x", 1.0, 4.0)], "shop string, item string, y double, yhat double")
    got = {(r["shop"], r["item"]): r["mae"] for r in metrics.evaluate_overall(df, ["mae"], ["shop", "item"]).collect()}
    assert got == {("a", "x"): 1.0, ("b", "x"): 3.0, (None, None): 2.0}


def test_metrics_of_many_horizons(spark):
    n = 20_000
    cv = spark.range(n).select(
        F.lit("k").alias("key"), F.lit(day("2024-01-01")).alias("cutoff"),
        (F.lit(day("2024-01-01")) + F.make_dt_interval(mins=(F.col("id") + 1).cast("int"))).alias("ds"),
        F.lit(1.0).alias("y"), (F.col("id").cast("double") + 1).alias("yhat"),
    )
    out = metrics.performance_metrics(cv, rolling_window=0.001).orderBy("horizon")
    first = out.first()
    assert out.count() == n - 19
    assert first["mae"] == pytest.approx(np.mean(np.arange(20))) and first["mdape"] == pytest.approx(9.5)


@pytest.mark.parametrize("rows", [10_000, 300])
def test_ema_over_gaps_is_the_library_rule(spark, rows):
    """Missing values age the weight of the last mean, as pandas does without adjustment."""
    rng = np.random.default_rng(8)
    n = 2000
    y = rng.normal(100, 5, n)
    y[rng.random(n) < 0.4] = np.nan
    y[:3], y[500:560], y[900:1500] = np.nan, np.nan, np.nan
    pdf = pd.DataFrame({"key": "k", "i": range(n), "y": y})
    df = spark.createDataFrame(pdf).selectExpr("key", "timestamp_seconds(i) AS ds", "CASE WHEN NOT isnan(y) THEN y END AS y")
    s = series(df, segment_rows=rows)
    got = rows_of(indicators.ema_frame(s, "y", {"a": 20, "b": 5}).df)
    for name, span in (("a", 20), ("b", 5)):
        want = pd.Series(y).ewm(span=span, min_periods=span, adjust=False).mean()
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9)


def test_metrics_of_twenty_thousand_horizons(spark):
    """The rolling median slides; no window is laid out row by row."""
    n = 20_000
    ds = F.timestamp_seconds(F.col("id") % n + 1)
    cv = spark.range(2 * n).select(
        F.lit("k").alias("key"), ds.alias("ds"), F.timestamp_seconds(F.lit(0)).alias("cutoff"),
        (F.lit(100.0) + F.pmod(F.col("id") * 7919, F.lit(997))).alias("y"), F.lit(100.0).alias("yhat"),
    )
    out = metrics.performance_metrics(cv)
    assert out.count() == n - 2000 + 1
    rows = cv.selectExpr("ds", "abs(y - yhat) / y AS e").toPandas().sort_values("ds", kind="stable")
    want = {n: rows.e.iloc[-4000:].median(), 2000: rows.e.iloc[:4000].median(), 9000: rows.e.iloc[14_000:18_000].median()}
    got = {r["horizon"]: r["mdape"] for r in out.collect()}
    for second, value in want.items():
        assert got[second * 1_000_000] == pytest.approx(value)


def test_sliding_medians():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 50, 777):
        v = np.round(rng.normal(size=n), 1)
        v[rng.random(n) < 0.1] = np.nan
        starts = np.sort(rng.integers(0, n, 30))
        stops = np.maximum.accumulate(np.minimum(n, starts + rng.integers(1, n + 1, 30)))
        want = [np.median(w) if len(w) else np.nan for w in (v[a:b][~np.isnan(v[a:b])] for a, b in zip(starts, stops))]
        np.testing.assert_allclose(metrics.sliding_medians(v, starts, stops), want)


def test_components_keep_rows_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.8, 0.1], [0, 0.5, 0.2], [0, 0, 1.0]])
    x[::7, 1] = np.nan
    x[5] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc")).assign(key="k", i=range(300), one=1.0)
    df = spark.createDataFrame(pdf).selectExpr("key", "timestamp_seconds(i) AS ds", "a AS y", "a", "b", "c", "one")
    out = rows_of(reduce.principal_components(series(df, max_rows=300), ["a", "b", "c", "one"], 3))
    frame = pd.DataFrame(x, columns=list("abc"))
    values, vectors = np.linalg.eigh(frame.corr())
    z = ((frame - frame.mean()) / frame.std()).fillna(0.0).to_numpy()
    for j in range(3):
        v = vectors[:, -1 - j]
        score = z @ (v * np.sign(v[0]))
        score[5] = np.nan
        np.testing.assert_allclose(out[f"pc_{j + 1}"].astype(float), score, atol=1e-9)


def test_trees_of_a_forest_draw_their_own_rows(spark, monkeypatch):
    """Of a long key every tree has a sample of its own, and two trees share rows by chance alone."""
    monkeypatch.setattr(clean, "TREES", 20)
    n = 100_000
    df = spark.range(n + 50).select(
        F.when(F.col("id") < n, "long").otherwise("short").alias("key"), F.timestamp_seconds("id").alias("ds"), F.col("id").cast("double").alias("y")
    )
    pool = clean.forest_pool(series(df, segment_rows=20_000)).toPandas()
    assert set(pool[pool.key == "short"].tree) == {-1} and (pool.key == "short").sum() == 50
    drawn = pool[pool.key == "long"].sort_values("rank").groupby("tree").head(clean.TREE_ROWS)
    sizes = drawn.groupby("tree").size()
    assert len(sizes) == 20 and (sizes == clean.TREE_ROWS).all()
    samples = [set(g.y) for _, g in drawn.groupby("tree")]
    shared = [len(a & b) for i, a in enumerate(samples) for b in samples[:i]]
    # 256 of 100,000 rows each: two thirds of a row in common on average, and no bias along the order.
    assert np.mean(shared) < 2 and max(shared) <= 8
    assert abs(drawn.y.mean() / n - 0.5) < 0.02

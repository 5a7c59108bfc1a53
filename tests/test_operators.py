"""Operators against pandas or definitions on small frames with edge cases."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.functions.calendar import add_calendar, holiday_table
from tidemark.functions.scalars import clip, normal_quantile, parse_duration
from tidemark.operators import charts, clean, features, indicators, metrics, profile
from tidemark.operators.enrich import as_of
from tidemark.plans.series import normalise, regressor_columns, series
from tidemark.sources import bars

RNG = np.random.default_rng(11)
WALK = list(np.round(100 + np.cumsum(RNG.normal(0, 2, 90)), 3))


def close(got, expected, tol=1e-9):
    got = np.array([np.nan if v is None else v for v in got], float)
    np.testing.assert_allclose(got, np.array(expected, float), rtol=tol, atol=tol)


# --- rolling, lags, split ---


@pytest.mark.parametrize("values", [WALK, [5.0] * 10, [1.0], [1.0, 2.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 9.0], [3.0] * 5 + [4.0, 8.0]])
def test_rolling_matches_pandas(make, values):
    got = rows_of(features.rolling_columns(make({"k": values}), (7,)).df)
    r = pd.Series(values).rolling(7, min_periods=1)
    for kind, exp in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max())):
        close(got[f"rolling_{kind}_7"], exp)
    x = pd.Series(values)
    for i in range(len(values)):
        w = x[max(0, i - 6) : i + 1]
        flat = w.nunique() == 1
        skew = np.nan if len(w) < 3 else 0.0 if flat else w.skew()
        kurt = np.nan if len(w) < 4 else -3.0 if flat else w.kurt()
        close([got["rolling_skew_7"][i]], [skew], 1e-7)
        close([got["rolling_kurt_7"][i]], [kurt], 1e-7)


def test_rolling_gaps_are_filled(make):
    got = rows_of(features.add_rolling(make({"k": WALK[:10], "one": [4.0]}), (7,)).df)
    assert got.filter(like="rolling_").drop(columns=["rolling_std_7"]).notna().all().all()
    first = got[got.key == "k"].iloc[0]
    assert first["rolling_std_7"] == pytest.approx(np.std(WALK[:2], ddof=1))
    one = got[got.key == "one"].iloc[0]
    assert one["rolling_skew_7"] == 0 and math.isnan(one["rolling_std_7"])


def test_lags_drop_warm_up_rows(make):
    got = rows_of(features.add_lags(make({"k": WALK}), (1, 7)).df)
    assert len(got) == len(WALK) - 7
    close(got["y_lag_7"], WALK[:-7])


def test_split_is_chronological(make):
    s = features.split_train_test(make({"k": WALK, "m": WALK[:11]}), 0.2)
    got = rows_of(s.df)
    for key, n in (("k", 90), ("m", 11)):
        part = got[got.key == key]
        assert part.is_train.sum() == int(n * 0.8)
        assert part[part.is_train].ds.max() < part[~part.is_train].ds.min()
    with pytest.raises(ValueError):
        features.split_train_test(s, 1.0)
    assert features.invalid_splits(make({"one": [1.0], "k": WALK})).first()["key"] == "one"


def test_standardize_train_only_and_constant(make):
    s = make({"k": WALK})
    s = features.split_train_test(s.on(s.df.withColumns({"x": F.col("y") * 2, "c": F.lit(3.0)})))
    got = rows_of(features.standardize(s, ["x", "c"], fit_on="train").df)
    train = np.array(WALK[:72]) * 2
    close(got["x"], (np.array(WALK) * 2 - train.mean()) / train.std())
    assert (got["c"] == 0).all()


def test_prepare_drops_duplicated_features(make):
    s = make({"k": WALK, "m": list(reversed(WALK))})
    out, dropped = features.prepare(s)
    assert dropped and not set(dropped) & set(out.df.columns)
    assert out.df.filter("is_train").count() > out.df.filter("NOT is_train").count()
    assert dict(out.df.dtypes)["ds"] == "timestamp_ntz"


# --- calendar ---


def test_holidays(spark):
    got = {(str(r["date"]), r["name"]) for r in holiday_table(spark, 1997, 2024).collect()}
    for day, name in (
        ("2024-01-01", "New Year's Day"), ("2024-01-15", "Martin Luther King Jr. Day"),
        ("2024-02-19", "Washington's Birthday"), ("2024-05-27", "Memorial Day"), ("2024-06-19", "Juneteenth"),
        ("2024-07-04", "Independence Day"), ("2024-09-02", "Labor Day"), ("2024-10-14", "Columbus Day"),
        ("2024-11-11", "Veterans Day"), ("2024-11-28", "Thanksgiving"), ("2024-12-25", "Christmas Day"),
        ("1998-07-03", "Independence Day (observed)"), ("2021-12-31", "New Year's Day (observed)"),
    ):
        assert (day, name) in got
    assert not any(n.startswith("Juneteenth") and d < "2021" for d, n in got)


def test_calendar_edges_match_pandas(spark):
    days = ["2024-12-31", "2024-01-01", "2024-02-29", "2026-07-03", "2024-03-31", "2024-06-30", "2024-10-01", "2021-01-03"]
    df = spark.createDataFrame([(pd.Timestamp(d).to_pydatetime(),) for d in days], "ds timestamp")
    got = add_calendar(df).toPandas().sort_values("ds").reset_index(drop=True)
    d = got.ds.dt
    for name, exp in (
        ("day_of_week", d.dayofweek), ("quarter", d.quarter), ("week_of_year", d.isocalendar().week),
        ("is_month_start", d.is_month_start), ("is_month_end", d.is_month_end), ("is_quarter_start", d.is_quarter_start),
        ("is_quarter_end", d.is_quarter_end), ("is_year_start", d.is_year_start), ("is_year_end", d.is_year_end),
    ):
        assert (got[name].astype(int) == exp.astype(int)).all(), name
    close(got["month_sin"], np.sin(2 * np.pi * d.month / 12))
    assert got.set_index(got.ds.astype(str)).loc["2026-07-03", "is_holiday"] == 1


# --- indicators ---


def _bars(make):
    s = make({"k": WALK, "flat": [7.0] * 40})
    return s.on(s.df.select("key", "ds", F.col("y").alias("Close"), (F.col("y") + 1).alias("High"), (F.col("y") - 1).alias("Low"), F.lit(2.0).alias("Volume"), "y"))


def test_indicators_match_definitions(make):
    got = rows_of(indicators.calculate_indicators(_bars(make), indicators.CATEGORIES, fill_gaps=False).df)
    k = got[got.key == "k"].reset_index(drop=True)
    x = pd.Series(WALK)
    close(k["SMA"], x.rolling(20).mean())
    close(k["EMA"], x.ewm(span=20, min_periods=20, adjust=False).mean())
    close(k["BB_upper"], x.rolling(20).mean() + 2 * x.rolling(20).std(ddof=0))
    close(k["VWAP"], x.rolling(14).mean())
    step = x.diff()
    up = step.where(step > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    down = (-step.where(step < 0, 0.0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    close(k["RSI"], 100 - 100 / (1 + up / down))
    assert k["RSI"].dropna().between(0, 100).all()
    assert (got[got.key == "flat"]["RSI"].dropna() == 100).all()


def test_ema_over_many_blocks(spark):
    n = 5000
    x = pd.Series(np.random.default_rng(2).normal(0, 1, n).cumsum())
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "i": range(n), "y": x}))
    s = series(df.withColumn("ds", F.timestamp_seconds("i")), max_rows=n)
    got = rows_of(indicators.ema_frame(s, "y", {"fast": 3, "slow": 26}, min_periods=False).df)
    close(got["fast"], x.ewm(span=3, adjust=False).mean(), 1e-9)
    close(got["slow"], x.ewm(span=26, adjust=False).mean(), 1e-9)
    far = rows_of(indicators.ema_frame(s, "y", {"quick": 1, "fast": 2, "slow": 400}, min_periods=False).df)
    close(far["quick"], x, 1e-9)
    close(far["fast"], x.ewm(span=2, adjust=False).mean(), 1e-9)
    close(far["slow"], x.ewm(span=400, adjust=False).mean(), 1e-9)


def test_filled_indicators_have_no_gaps(make):
    got = rows_of(indicators.calculate_indicators(_bars(make), ()).df)
    assert got[["SMA", "EMA", "RSI"]].notna().all().all()
    assert got["SMA"].between(got["y"].min(), got["y"].max()).all()


def test_registered_indicators(make):
    indicators.register_indicator("twice", lambda w: F.col("y") * 2, 1)
    indicators.register_pandas_indicator("diff2", lambda rows: rows["y"].diff(2), 3)
    got = rows_of(indicators.custom_indicators(make({"k": WALK}), ["twice", "diff2"]).df)
    close(got["twice"], np.array(WALK) * 2)
    close(got["diff2"], pd.Series(WALK).diff(2))
    with pytest.raises(ValueError):
        indicators.custom_indicators(make({"k": WALK}), ["nothing"])


# --- cleaning ---


def test_fills_and_interpolation(make):
    s = make({"k": [None, 1.0, None, None, 4.0, None]}, days=[0, 1, 2, 5, 7, 9])
    assert [v for v in rows_of(clean.handle_missing(s, "ffill").df)["y"].tolist()][1:] == [1, 1, 1, 4, 4]
    assert rows_of(clean.handle_missing(s, "backward").df)["y"].tolist()[:5] == [1, 1, 4, 4, 4]
    close(rows_of(clean.handle_missing(s, "interpolate").df)["y"], [1, 1, 1.5, 3, 4, 4])
    close(rows_of(clean.handle_missing(s, "impute").df)["y"], [2.5, 1, 2.5, 2.5, 4, 2.5])
    assert clean.handle_missing(s, "drop").df.count() == 2
    with pytest.raises(ValueError):
        clean.handle_missing(s, "guess")


def test_all_null_series_passes(make):
    s = make({"k": [None, None, None]})
    for method in ("impute", "interpolate", "ffill", "bfill"):
        assert rows_of(clean.handle_missing(s, method).df)["y"].isna().all()
    assert profile.target_shape(s.df).first()["skew"] is None


SPIKY = [10.0, 11, 9, 10, 12, 8, 10, 11, 9, 10, 10, 11, 500, 9, 10, 12, -400, 10, 9, 11]


def test_detectors(make):
    s = make({"k": SPIKY, "flat": [5.0] * 12})
    for method in ("iqr", "isolation_forest", "elliptic_envelope"):
        got = rows_of(clean.DETECTORS[method](s).df)
        flagged = set(got[(got.key == "k") & got.is_outlier]["y"])
        assert {500.0, -400.0} <= flagged, method
    got = rows_of(clean.zscore_outliers(s, 2.0).df)
    assert set(got[got.is_outlier]["y"]) == {500.0, -400.0}
    assert not got[got.key == "flat"].is_outlier.any()


def test_envelope_follows_its_definition(make):
    x = np.round(np.random.default_rng(4).normal(0, 1, 60), 4)
    x[:4] = [9, -8, 7, 12]
    got = rows_of(clean.envelope_outliers(make({"k": list(x)})).df)
    n = len(x)
    h = math.ceil((n + 2) / 2)
    v = np.sort(x)
    spans = v[h:] - v[: n - h]
    at = np.flatnonzero(spans == spans.min())
    loc = (0.5 * (v[h + at] + v[at])).mean()
    near = np.argsort(np.abs(x - loc))[:h]
    d2 = (x - loc) ** 2 / np.var(x[near])
    kept = d2 / (np.median(d2) / clean.CHI2_500) < clean.CHI2_975
    dist = (x - x[kept].mean()) ** 2 / np.var(x[kept])
    assert got.is_outlier.tolist() == (dist > np.quantile(dist, 0.9)).tolist()


def test_forest_share_and_repeatability(make):
    x = list(np.round(np.random.default_rng(8).normal(0, 1, 400), 5))
    s = make({"k": x})
    a, b = (rows_of(clean.forest_outliers(s).df) for _ in range(2))
    assert a.is_outlier.tolist() == b.is_outlier.tolist()
    assert 30 <= a.is_outlier.sum() <= 40
    scores = rows_of(clean.forest_scores(s).df)
    assert scores["score"].between(-1, 0).all()
    far, near = scores["y"].abs() > 2.5, scores["y"].abs() < 0.5
    assert scores[far]["score"].mean() < scores[near]["score"].mean()


def test_treatments(make):
    s = make({"k": SPIKY})
    clipped = rows_of(clean.handle_outliers(s, "iqr", "clip").df)["y"]
    assert clipped.max() == pytest.approx(np.quantile(SPIKY, 0.99))
    assert len(rows_of(clean.handle_outliers(s, "iqr", "remove").df)) == 18
    w = rows_of(clean.winsorize(s, 0.1, 0.1).df)["y"]
    assert w.max() == sorted(SPIKY)[-3] and w.min() == sorted(SPIKY)[2]
    assert clean.handle_outliers(s, "none") is s
    with pytest.raises(ValueError):
        clean.handle_outliers(s, "magic")
    stats = clean.outlier_stats(clean.iqr_outliers(s)).first()
    assert (stats["n_outliers"], stats["min_outlier"], stats["max_outlier"]) == (2, -400.0, 500.0)


def test_cleaning_leaves_no_gaps(make):
    s = make({"k": [None, *SPIKY, None]})
    for method in ("impute", "interpolate", "drop"):
        assert rows_of(clean.clean(s, method).df)["y"].notna().all()


# --- profile ---


def test_validation_flags(spark):
    t = lambda d: pd.Timestamp(d).to_pydatetime()
    rows = [("a", t("2024-01-01"), 1.0, 1), ("a", t("2024-01-02"), -1.0, 3), ("a", t("2024-01-02"), 2.0, 2), ("a", t("2024-01-20"), 2.0, 4), ("b", t("2024-01-01"), 1.0, 2), ("b", t("2024-01-03"), 1.0, 1)]
    s = series(spark.createDataFrame(rows, "key string, ds timestamp, y double, n int"), seq=["n"], max_rows=10)
    got = {r["key"]: r for r in profile.validate_series(s, F.lit("2024-01-10").cast("timestamp"), arrival="n").collect()}
    a, b = got["a"], got["b"]
    assert (a["n_duplicates"], a["n_negative"], a["n_future"], a["range_days"]) == (1, 1, 1, 19)
    assert a["large_gap"] and not a["short_range"] and a["n_disordered"] == 0
    assert b["short_range"] and b["n_disordered"] == 1


def test_dtype_issues(spark):
    df = spark.createDataFrame([("x", "y")], "ds string, y string")
    assert len(profile.dtype_issues(df, required=["Close"])) == 3


def test_correlation_decisions(make, spark):
    s = make({"k": WALK})
    s = s.on(s.df.withColumns({"a": F.rand(3), "one": F.lit(1.0)}))
    s = s.on(s.df.withColumns({"b": -F.col("a") * 2 + 1, "c": F.rand(4)}))
    assert profile.correlated_columns(s.df, ["a", "one", "b", "c"], 0.95) == ["b"]
    assert profile.correlated_columns(s.df, ["a"], 0.95) == []


def test_infinities_and_nan(spark):
    df = normalise(spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "x double"))
    assert profile.infinity_profile(df).first()["infinities"] == 1
    assert profile.null_profile(df).first()["nulls"] == 1
    q = profile.feature_quality(df.filter("x = 1"), ["x"]).first()
    assert q["is_constant"]


def test_approximate_unique_is_close(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("v"))
    got = profile.approximate_unique(df, ["v"]).first()["n_unique"]
    assert abs(got - 1000) < 100


# --- metrics ---


def test_zero_actual_and_perfect_forecast(make):
    s = make({"k": [0.0, 2.0, 4.0]})
    df = s.df.withColumn("yhat", F.col("y") + F.when(F.col("y") == 2, 1.0).otherwise(0.0))
    got = metrics.evaluate_forecast(df).first()
    assert got["rmse"] == pytest.approx(math.sqrt(1 / 3)) and got["mape"] == pytest.approx(25.0)


def test_performance_metrics_backward_loop(spark):
    """Against the trailing loop from the longest horizon, with uneven groups."""
    rng = np.random.default_rng(3)
    for trial in range(4):
        counts = rng.integers(1, 6, 12)
        h = np.repeat(np.arange(1, 13), counts)
        y, yhat = rng.normal(10, 1, len(h)), rng.normal(10, 1, len(h))
        pdf = pd.DataFrame({"key": "k", "y": y, "yhat": yhat, "h": h, "i": range(len(h))})
        df = spark.createDataFrame(pdf).selectExpr(
            "key", "y", "yhat", "timestamp_seconds(i * 864000) AS cutoff", "timestamp_seconds(i * 864000 + h * 86400) AS ds"
        )
        w = max(int(len(h) * 0.3), 1)
        got = metrics.performance_metrics(df, 0.3).toPandas().sort_values("horizon")
        x = (y - yhat) ** 2
        expected = []
        for top in range(12):
            need, total = w, 0.0
            for g in range(top, -1, -1):
                part = x[h == g + 1]
                take = min(need, len(part))
                total += part.mean() * take
                need -= take
                if need == 0:
                    break
            if need == 0:
                expected.append(total / w)
        close(got["mse"], expected, 1e-8)


def test_last_rows_and_summary(make):
    s = make({"k": WALK, "m": WALK[:5]})
    s = s.on(s.df.withColumn("yhat", F.col("y")))
    got = {r["key"]: r for r in metrics.forecast_summary(s, 10).collect()}
    assert got["k"]["periods"] == 10 and got["m"]["periods"] == 5
    assert got["k"]["mean"] == pytest.approx(np.mean(WALK[-10:]))


# --- charts, scalars, sources ---


def test_normal_quantile(spark):
    p = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(v,) for v in p], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-7)


def test_qq_of_normal_values_is_a_line(make):
    x = [NormalDist(5, 2).inv_cdf((i - 0.3175) / 100.365) for i in range(1, 101)]
    got = charts.qq_points(make({"k": x})).toPandas()
    r = np.corrcoef(got["value"], got["theoretical"])[0, 1]
    assert r > 0.9999


def test_histogram_counts_everything(make):
    got = charts.histogram(make({"k": WALK, "flat": [2.0] * 5})).toPandas()
    assert got[got.key == "k"]["n"].sum() == 90 and got[got.key == "flat"]["n"].tolist() == [5]


def test_clip_keeps_null(spark):
    row = spark.range(1).select(clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)).alias("x")).first()
    assert row["x"] is None
    assert parse_duration("30 days") == 30 * 86400


def test_as_of(make, spark):
    s = make({"k": [1.0, 2.0, 3.0, 4.0]})
    other = spark.createDataFrame([(pd.Timestamp("2024-01-02").to_pydatetime(), 7.0), (pd.Timestamp("2024-01-03 12:00").to_pydatetime(), 8.0)], "ds timestamp, z double")
    assert [None if pd.isna(v) else v for v in rows_of(as_of(s, other, ["z"]))["z"]] == [None, 7.0, 7.0, 8.0]


def test_intervals_and_ranges(spark):
    with pytest.raises(ValueError):
        bars.interval_seconds("7m")
    with pytest.raises(ValueError):
        bars.date_range(spark.range(1).select(F.current_timestamp().alias("ds")), "2024-01-01", "2024-02-01")
    df = spark.createDataFrame([("a", pd.Timestamp("2023-01-01").to_pydatetime(), 1.0)], "key string, Date timestamp, Adj_Close double")
    assert bars.to_series(df, "Date").columns == ["key", "ds", "y"]
    with pytest.raises(ValueError):
        bars.to_series(df.drop("Adj_Close"), "Date")


def test_bars_keep_first_and_last_price(spark):
    t = lambda s: pd.Timestamp(f"2024-01-01 {s}").to_pydatetime()
    rows = [("a", t("10:00"), 1, 5.0), ("a", t("10:00"), 2, 6.0), ("a", t("10:30"), 3, 1.0), ("a", t("11:00"), 4, 9.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, price double")
    got = rows_of(bars.make_bars(df, "2024-01-01", "2024-01-02", "1h", "k", volume=F.lit(1.0), tie=["id"]).df)
    assert got.iloc[0][["Open", "High", "Low", "Close", "Volume"]].tolist() == [5, 6, 1, 1, 3]


def test_csv_source_coerces(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "x.csv").write_text("day,value,id\n2024-01-01,1.5,a\nnot a day,2,a\n2024-01-03,oops,a\n")
    df = bars.load_csv(spark, str(path), ds="day", y="value", key="id")
    check = bars.load_checks(df).first()
    assert (check["n_rows"], check["bad_dates"], check["missing_y"], check["too_few"]) == (3, 1, 1, True)
    with pytest.raises(ValueError):
        bars.load_csv(spark, str(path), ds="when")
    bars.write_csv(df, str(tmp_path / "out"), ["key"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 3


def test_load_bars(spark, tmp_path):
    rows = [(k, pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for k, n in (("a", 40), ("b", 10)) for i in range(n)]
    spark.createDataFrame(rows, bars.BAR_SCHEMA).write.parquet(str(tmp_path / "bars"))
    assert {r["key"] for r in bars.load_bars(spark, str(tmp_path / "bars")).select("key").distinct().collect()} == {"a"}
    assert bars.load_bars(spark, str(tmp_path / "bars"), ["b"], min_points=5).count() == 10


def test_regressors(make):
    s = make({"k": WALK})
    s = s.on(s.df.withColumns({"volume": F.lit(1.0), "month": F.month("ds"), "name": F.lit("x")}))
    assert regressor_columns(s) == ["volume"]
    assert regressor_columns(s, all_numeric=True) == ["volume", "month"]

"""Rewrites for larger tables give the results of the plain forms."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import datasets
from tidemark.models import ensemble
from tidemark.operators import features
from tidemark.plans.series import series


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b):
    assert a.columns == b.columns
    left, right = (sorted(map(repr, d.collect())) for d in (a, b))
    assert left == right


def test_rolling_frames_equal_the_window_functions(spark):
    """Gaps, short keys, constant stretches, NULL keys and frames across Arrow batches."""
    rows = [(k, i, None if i % 7 == 3 else float((i * i * 37) % 101 if i % 50 < 30 else 5.1)) for k in ("a", "b", None) for i in range(130)]
    rows += [("c", i, float(i)) for i in range(3)] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "key string, i int, y double").withColumn("ds", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, i)"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        s = series(df, max_rows=200)
        w = Window.partitionBy("key").orderBy("ds")
        new = features.rolling_columns(s, (3, 14)).df
        old = df.withColumns({f"rolling_{k}_{n}": features._statistic(w, F.col("y"), n, k) for n in (3, 14) for k in features.STATISTICS})
        assert set(new.columns) == set(old.columns)
        got, want = (d.orderBy("key", "ds").collect() for d in (new.select(old.columns), old))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) == len(rows)
    for g, x in zip(got, want):
        for c in old.columns:
            assert g[c] == (pytest.approx(x[c], rel=1e-9, abs=1e-9) if isinstance(x[c], float) else x[c]), (c, g, x)


def test_rolling_columns_are_not_summed_frame_by_frame(spark):
    """A window function that slides would add up every frame anew."""
    s = series(spark.range(9).selectExpr("'a' AS key", "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS ds", "CAST(id AS DOUBLE) AS y"), max_rows=9)
    plan = features.rolling_columns(s, (3,)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "kurtosis" not in plan and "MapInArrow" in plan


def test_days_without_sales_need_no_join(spark, tmp_path):
    """Days up to the next sale come from the sale's own row; a NULL supplier has no known sales, as before."""
    rows = [(k, d, float(q), 10.0 * q, 0.1) for k in (1, 2, None) for d, q in ((1, 1), (1, 2), (4, 3), (9, 4))] + [(3, 7, 1.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "l_suppkey long, d int, l_quantity double, l_extendedprice double, l_discount double")
    df = df.withColumn("l_shipdate", F.expr("timestamp_ntz'2024-01-01 05:00:00' + make_interval(0, 0, 0, d)")).drop("d")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    sold = datasets.supp_daily(spark, str(tmp_path)).df
    spans = sold.groupBy("key").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    dense = spans.select("key", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 DAY)")).alias("ds"))
    new = datasets.supp_gappy(spark, str(tmp_path)).df
    same_rows(new, dense.join(sold, ["key", "ds"], "left"))
    assert new.count() == 28 and "Join" not in plan_of(new)


def _predictions(spark, bounded):
    rows = [(k, i, m, float((i * p) % 11)) for k in ("a", "b", None) for i in range(12) for m, p in (("x", 3), ("z", 5))]
    df = spark.createDataFrame(rows, "key string, i int, model string, yhat double").withColumn("ds", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, i)"))
    actual = df.where("model = 'x' AND i NOT IN (3, 4, 11)").select("key", "ds", (F.col("i") % 5).cast("double").alias("y"))
    return series(df.drop("i"), ("key", "model"), y="yhat", max_rows=12 if bounded else None, segment_rows=1_000), actual


def test_weights_of_bounded_series_move_rows_to_their_key_once(spark):
    found = []
    for bounded in (True, False):
        long, actual = _predictions(spark, bounded)
        out = ensemble.dynamic_weights(long, actual, 3).withColumn("weight", F.round("weight", 9))
        found.append(out)
    assert plan_of(found[0]).count("hashpartitioning") <= 3  # both sides of the join, and the key
    assert found[0].count() == 72
    # An unbounded series of few rows is counted and then taken as bounded: the plain windows are the other form.
    long, actual = _predictions(spark, True)
    every = long.df.join(actual.withColumn("_known", F.lit(True)), ["key", "ds"], "left")
    own = Window.partitionBy("key", "model").orderBy("ds")
    known = every.where("_known").withColumns({
        "_mae": F.avg(F.abs(F.col("yhat") - F.col("y"))).over(own.rowsBetween(-3, -1)), "_seen": F.count(F.lit(1)).over(own.rowsBetween(-3, -1)),
    })
    weight = F.when(F.col("_seen") < 3, F.lit(0.5)).otherwise(ensemble._inverse_error(F.col("_mae"), ["key", "ds"]))
    both = known.withColumn("_w", weight).select(*every.columns, "_w").unionByName(every.where("_known IS NULL").withColumn("_w", F.lit(None).cast("double")))
    want = both.withColumn("weight", F.round(F.coalesce(F.last("_w", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.5)), 9))
    for out in found:
        same_rows(out, want.select("key", "ds", "model", "yhat", "y", "weight"))


def test_models_are_aligned_in_one_aggregation(spark):
    long, _ = _predictions(spark, True)
    new = ensemble.wide(long.df, ["x", "z", "none"])
    assert plan_of(new).count("hashpartitioning") == 1
    same_rows(new, long.df.groupBy("key", "ds").pivot("model", ["x", "z", "none"]).agg(F.first("yhat")))


@pytest.mark.parametrize("rows,start,period", [(5, 3, 7), (7, 0, 7), (500, 11, 7), (2000, 4, 30)])
def test_blocks_of_a_segment_smooth_as_one(rows, start, period):
    rng = np.random.default_rng(rows)
    y = rng.normal(100, 30, rows)
    combos = len(ensemble._factors()[0])
    state = rng.normal(size=(combos, period + 2))
    sse, ends = ensemble.run_smoothing(y, start, state, period)
    m = ensemble.smoothing_maps(y, start, period)
    np.testing.assert_allclose((m[..., :-1] @ state[..., None])[..., 0] + m[..., -1], ends, rtol=1e-8, atol=1e-7)
    both = ensemble.run_segment(y, start, state, period)
    np.testing.assert_allclose(both[0], sse, rtol=1e-8)
    np.testing.assert_allclose(both[1], ends, rtol=1e-8, atol=1e-7)
    assert ensemble._parts(y, period)[0].shape[1] <= ensemble.BLOCKS


def test_rows_of_one_time_meet_before_the_rounds(spark, monkeypatch):
    """Rounds read one row per key and time, and the fit is that of all rows."""
    from tidemark.models import design, fit

    df = spark.range(4000).selectExpr(
        "CASE id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS key", "id",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id DIV 40 AS INT)) AS ds", "100.0D + id * 0.05 + (id * 7919) % 13 AS y",
    )
    read, plain = [], fit.attach
    monkeypatch.setattr(fit, "attach", lambda s, stats: (read.append(s.df.count()), plain(s, stats))[1])
    o = design.ForecastOptions(yearly=False, daily=False)
    got = {r.key: r for r in fit.fit_long(series(df, seq=["id"], segment_rows=300), o).collect()}
    want = {r.key: r for r in fit.fit(series(df, seq=["id"], max_rows=4000), o).collect()}
    assert read and set(read) == {200}
    for k in want:
        assert got[k].status == "ok" and got[k].n == want[k].n == 2000
        assert got[k].sigma == pytest.approx(want[k].sigma, rel=1e-3)
        assert got[k].trend[0] == pytest.approx(want[k].trend[0], rel=1e-2)


def test_series_smoothed_together_are_those_smoothed_alone():
    rng = np.random.default_rng(3)
    ys = [rng.normal(50, 9, n) for n in (24, 25, 90, 61, 24, 300)]
    ys[3][40] = np.nan
    steps = [3, 1, 30, 5, 0, 40]
    for got, y, n in zip(ensemble.smooth_together(ys, steps, 12), ys, steps, strict=True):
        np.testing.assert_array_equal(got, ensemble.smooth_arrays(y, n, 12))


def test_keys_are_smoothed_beside_each_other(spark, monkeypatch):
    """No Python call per key; keys across batches and chunks, short, NULL and unknown ones, NULL times to forecast."""
    monkeypatch.setattr(ensemble, "SMOOTHED_ROWS", 40)
    sizes = {"a": 70, "b": 13, "c": 33, None: 41, "d": 30, "idle": 50}
    rows = [(k, i, float((i * i * 31) % 17 + i)) for k, n in sizes.items() for i in range(n)] + [("c", 99, None)]
    ahead = [(k, i) for k in ("a", "b", "c", None, "d", "new") for i in (205, 203, None, 204)]
    at = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, i)").alias("ds")
    train = series(spark.createDataFrame(rows, "key string, i int, y double").select("key", at, "y"), max_rows=100)
    target = spark.createDataFrame(ahead, "key string, i int").select("key", at)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = ensemble.exp_smoothing(train, target, 12)
        got = {(r.key, r.ds and r.ds.day): (r.yhat, r.status) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = plan_of(out)
    assert "MapInArrow" in plan and "CoGroup" not in plan
    want = {}
    for k in ("a", "b", "c", None, "d", "new"):
        y = np.array([v for key, i, v in rows if key == k and v is not None])
        short = len(y) < 24
        found = [None] * 4 if short else ensemble.smooth_arrays(y, 4, 12).tolist()
        days = [*(r.day for r in spark.sql("SELECT explode(array(203, 204, 205)) AS i").select(F.dayofmonth(at).alias("day")).collect()), None]
        want |= {(k, d): (v, f"needs 24 rows, got {len(y)}" if short else "ok") for d, v in zip(days, found)}
    assert got == want


def test_copied_rows_of_segments_do_not_come_back_from_python(spark):
    """Rows copied for the look-back end in Python, and segments are told apart by the sort prefix."""
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS key", "id",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id DIV 50 AS INT)) AS ds", "CASE WHEN id % 11 <> 4 THEN (id * 7919 % 1009) / 8.0D END AS y",
    )
    new = features.rolling_columns(series(df, seq=["id"], segment_rows=200), (7,)).df
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert "Filter" not in above and "_cell" not in below.split("\n")[0] and "[_seg" in below
    plain = features.rolling_columns(series(df, seq=["id"], max_rows=3000), (7,)).df
    assert new.count() == 3000
    same_rows(new.select(sorted(new.columns)), plain.select(sorted(new.columns)))


def test_shown_doubles_are_rounded_as_by_decimals(spark):
    """Numbers are rounded without a decimal where that gives the same, ties and large ones by it."""
    from pyspark.sql import types as T

    from catalog import registry

    rng = np.random.default_rng(8)
    values = [*(rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-9, 19, 3000)), *(rng.integers(-10**6, 10**6, 1000) / 2e4), *np.nextafter(rng.integers(-999, 999, 500) / 2e4, np.inf)]
    values += [0.0, -0.0, -0.00004, float("nan"), float("inf"), float("-inf"), None, 1e300, 4.5e15, 123456.00005, -123456.00005]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    for digits in (0, 3, 4):
        shown = registry._shown(T.StructField("v", T.DoubleType()), digits)
        old = F.round(F.col("v") + F.lit(registry._nudge(digits)), digits) + F.lit(0.0)
        rows = df.select("v", shown.alias("new"), old.alias("old")).where("NOT (new <=> old) OR (new = 0 AND CAST(new AS STRING) <> CAST(old AS STRING))")
        assert rows.collect() == []
    assert shown._jc.toString().count("round") == 1 and "CASE WHEN" in shown._jc.toString()


def test_keys_are_fitted_from_tables_of_many(spark, monkeypatch):
    """No Python call per key: gaps, NULL keys, times and regressors, keys across batches and chunks, as fitted alone."""
    from tidemark.models import design, fit

    monkeypatch.setattr(fit, "FITTED_ROWS", 50)
    rows = [(k, i, None if i % 9 == 4 else 50.0 + i + (i * i * 7) % 13, float(i % 4)) for k, n in (("a", 70), ("b", 33), (None, 45)) for i in range(n)]
    rows += [("one", 1, 5.0, 0.0), ("untimed", 1, 5.0, 0.0), ("untimed", 2, 6.0, 0.0), ("untimed", None, 7.0, 0.0), ("bad", 1, 2.0, None), ("bad", 2, 3.0, 1.0), ("bad", 3, 5.0, 1.0)]
    df = spark.createDataFrame(rows[::-1], "key string, i int, y double, x double").withColumn("ds", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, i)"))
    o = design.ForecastOptions(regressors=("x",))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = fit.fit(series(df, max_rows=100), o)
        got = {r.key: r.asDict() for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = plan_of(out)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and set(got) == {"a", "b", None, "one", "untimed", "bad"}
    first = 1704067200000000
    for k in ("a", "b", None):
        part = [r for r in rows if r[0] == k]
        us, y, x = (np.array([v(r) for r in part]) for v in (lambda r: first + r[1] * fit.DAY_US, lambda r: np.nan if r[2] is None else r[2], lambda r: r[3]))
        want = fit.fit_arrays(us, y, x[:, None], o)
        for name, v in want.items():
            assert got[k][name] == (v.tolist() if isinstance(v, np.ndarray) else v), (k, name)
    assert "two known values" in got["one"]["status"] and "regressor" in got["bad"]["status"] and "NaN" in got["untimed"]["status"]
    assert got["bad"]["trend"] == [] and got["bad"]["n"] is None and got["bad"]["sigma"] is None


def test_rolling_gaps_of_whole_keys_are_filled_in_one_pass(spark, monkeypatch):
    """Next value, else the key's statistic or 0: across Arrow batches and tables of keys, and no second shuffle."""
    rows = [(k, i, None if i % 7 == 3 or i > 120 else float((i * i * 37) % 101 if i % 50 < 30 else 5.1)) for k in ("a", "b", None) for i in range(130)]
    rows += [("c", i, float(i)) for i in range(3)] + [("d", 0, None), ("e", 0, 4.0)] + [("f", i, None) for i in range(5)]
    df = spark.createDataFrame(rows[::-1], "key string, i int, y double").withColumn("ds", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, i)"))
    s = series(df, max_rows=200)
    names = {f"rolling_{k}_{n}": k for n in (3, 14) for k in features.STATISTICS}
    w = Window.partitionBy("key").orderBy(F.desc("ds")).rowsBetween(Window.unboundedPreceding, 0)
    key = Window.partitionBy("key")
    rest = {"mean": F.avg("y"), "std": F.stddev_samp("y"), "min": F.min("y"), "max": F.max("y")}
    rest = {k: c.over(key) for k, c in rest.items()} | {"skew": F.lit(0.0), "kurt": F.lit(0.0)}
    plain = features.rolling_columns(s, (3, 14)).df
    plain = plain.withColumns({n: F.coalesce(F.last(n, ignorenulls=True).over(w), rest[k]) for n, k in names.items()})
    monkeypatch.setattr(features, "WHOLE_ROWS", 40)
    monkeypatch.setattr(features, "FRAME_VALUES", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        new = features.add_rolling(s, (3, 14)).df
        assert new.columns == plain.columns
        got, want = (d.orderBy("key", "ds").collect() for d in (new, plain))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan_of(new).count("Exchange hashpartitioning") == 1
    assert len(got) == len(want) == len(rows)
    for g, x in zip(got, want):
        for c in new.columns:
            assert g[c] == (pytest.approx(x[c], rel=1e-9, abs=1e-9) if isinstance(x[c], float) else x[c]), (c, g, x)


def test_features_of_the_workflow_stay_with_their_key(spark):
    """Models are fitted and asked where the features lie: no row of them is moved after its key came together."""
    from tidemark.models.design import ForecastOptions
    from tidemark.plans.workflow import WorkflowConfig, run_workflow

    days = spark.range(400).crossJoin(spark.createDataFrame([("a",), ("b",)], "key string"))
    df = days.selectExpr("key", "timestamp'2022-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS ds", "100 + (id * 7919 % 101) / 4.0D AS y")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = run_workflow(series(df, max_rows=400), WorkflowConfig(periods=40, options=ForecastOptions(samples=20)))
        assert "Exchange hashpartitioning" not in plan_of(out["params"])
        moved = [x for x in plan_of(out["metrics"]).split("\n") if "Exchange hashpartitioning" in x]
        # Parameters, forecasts and actual values by key and time, and errors by key.
        assert 1 <= len(moved) <= 4
        history = out["features"].where("is_train")
        n = {r.key: r["count"] for r in history.groupBy("key").count().collect()}
        got = {r.key: r["count"] for r in out["forecast"].groupBy("key").count().collect()}
        assert got == {k: v + 40 for k, v in n.items()} and set(n) == {"a", "b"}
        assert {r.key for r in out["metrics"].collect()} == {"a", "b"} == {r.key for r in out["summary"].collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""Queries over forecasting, evaluation, tuning, ensembles and versions."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog.datasets import (
    BARS, GAPPY, REV, SEG, SHIP, SUPP, event_bars, rev_daily, seg_daily, ship_rows, supp_daily, supp_gappy, table,
)
from catalog.registry import query, r, ts
from tidemark.models import cv, design, ensemble, tune
from tidemark.models import fit as fitting
from tidemark.models import predict as predicting
from tidemark.operators import charts, features, metrics
from tidemark.plans.segments import planned, windowed
from tidemark.plans.series import Series
from tidemark.plans.workflow import WorkflowConfig, run_workflow
from tidemark.session import shared_dir
from tidemark.sources import bars as src
from tidemark.sources import versions

# --- naive forecasts that SQL can state too: every metric is checked on them --------------------------


def naive(s: Series) -> Series:
    """Seasonal-naive forecast (7 rows back) with a fixed band, beside the actual value."""
    df = windowed(s, 7, lambda w: {"yhat": F.lag("y", 7).over(w)}).filter("yhat IS NOT NULL")
    return s.filtered(df.withColumns({"yhat_lower": F.col("yhat") * 0.7, "yhat_upper": F.col("yhat") * 1.3}))


NAIVE = """nv AS (SELECT key, ds, y, yhat, yhat * 0.7::DOUBLE AS yhat_lower, yhat * 1.3::DOUBLE AS yhat_upper
  FROM (SELECT key, ds, y, lag(y, 7) OVER (PARTITION BY key ORDER BY ds) AS yhat FROM {t}) WHERE yhat IS NOT NULL)"""
NSUPP = SUPP + ", " + NAIVE.format(t="supp")
NSEG = SEG + ", " + NAIVE.format(t="seg")


@query(f"""WITH {NSUPP} SELECT key, {r('sqrt(avg(pow(y - yhat, 2)))')} AS rmse, {r('avg(abs(y - yhat))')} AS mae,
{r('avg(abs(y - yhat) / y) * 100')} AS mape FROM nv GROUP BY 1""")
def evaluate_forecast(spark, d):
    s = naive(supp_daily(spark, d))
    joined = metrics.with_actual(s.df.drop("y"), s.df.select("key", "ds", "y"))
    return metrics.evaluate_forecast(joined)


@query(f"""WITH {NSUPP} SELECT key, {r('sqrt(avg(pow(y - yhat, 2)))')} AS rmse, {r('avg(abs(y - yhat))')} AS mae,
{r('avg(abs(y - yhat) / y) * 100')} AS mape FROM nv GROUP BY ROLLUP (key)""")
def evaluate_overall(spark, d):
    return metrics.evaluate_overall(naive(supp_daily(spark, d)).df)


@query(f"""WITH {NSUPP} SELECT key, {r('avg(abs(y - yhat))')} AS mae, {r('sqrt(avg(pow(y - yhat, 2)))')} AS rmse,
{r('avg(abs((y - yhat) / y)) * 100')} AS mape,
{r('avg((y BETWEEN yhat_lower AND yhat_upper)::INT) * 100')} AS coverage FROM nv GROUP BY 1""")
def evaluate_ensemble(spark, d):
    return metrics.evaluate_ensemble(naive(supp_daily(spark, d)).df)


@query(f"""WITH {NSUPP}, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds DESC) AS rn FROM nv)
SELECT key, {ts('min(ds)')} AS start, {ts('max(ds)')} AS "end", count(*) AS periods, {r('avg(yhat)')} AS mean,
{r('min(yhat)')} AS min, {r('max(yhat)')} AS max, {r('stddev_samp(yhat)')} AS std FROM q WHERE rn <= 30 GROUP BY 1""")
def forecast_summary(spark, d):
    return metrics.forecast_summary(naive(supp_daily(spark, d)), 30)


@query(f"""WITH {NSUPP}, l AS (SELECT key, max(ds) AS last FROM supp WHERE ds < TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT nv.key AS key, {ts('ds')} AS ds, ds > last AS is_future FROM nv JOIN l ON l.key = nv.key""")
def split_history_future(spark, d):
    s = naive(supp_daily(spark, d))
    history = s.df.filter(F.col("ds") < F.lit("2001-01-01").cast("timestamp"))
    return metrics.split_history_future(s.df, history).select("key", "ds", "is_future")


@query(f"""WITH {NSUPP} SELECT key, {ts("date_trunc('month', ds)")} AS period, count(*) AS n,
{r('avg(pow(y - yhat, 2))', 2)} AS mse, {r('avg(abs(y - yhat))', 2)} AS mae FROM nv GROUP BY 1, date_trunc('month', ds)""", digits=2)
def error_by_month(spark, d):
    return metrics.error_by_period(naive(supp_daily(spark, d)).df)


@query(f"""WITH {NSUPP} SELECT key, {ts('ds')} AS ds, {r('sqrt(avg(pow(y - yhat, 2)) OVER f)')} AS rolling_rmse,
{r('avg(abs(y - yhat)) OVER f')} AS rolling_mae FROM nv WINDOW f AS (PARTITION BY key ORDER BY ds ROWS 29 PRECEDING)""")
def rolling_error(spark, d):
    return metrics.rolling_error(naive(supp_daily(spark, d))).select("key", "ds", "rolling_rmse", "rolling_mae")


@query(f"""WITH {NSUPP}, x AS (SELECT key, sign(y - lag(y) OVER w) AS a, sign(yhat - lag(yhat) OVER w) AS b
  FROM nv WINDOW w AS (PARTITION BY key ORDER BY ds))
SELECT key, {r('avg((a = b)::INT)')} AS directional_accuracy, count(a) AS n_steps FROM x GROUP BY 1""")
def directional_accuracy(spark, d):
    return metrics.directional_accuracy(naive(supp_daily(spark, d)))


@query(f"""WITH {NSEG}, x AS (SELECT key, ds, coalesce(sign(yhat - lag(y) OVER w) * (y / lag(y) OVER w - 1), 0) AS pnl
  FROM nv WINDOW w AS (PARTITION BY key ORDER BY ds)),
e AS (SELECT *, sum(pnl) OVER (PARTITION BY key ORDER BY ds) AS eq FROM x),
p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY key ORDER BY ds), 0) AS peak FROM e)
SELECT key, {r('sum(pnl)')} AS total_pnl, {r('avg(pnl) / stddev_samp(pnl) * sqrt(252)')} AS sharpe,
{r('max(peak - eq)')} AS max_drawdown FROM p GROUP BY 1""")
def strategy_report(spark, d):
    return metrics.strategy_report(naive(seg_daily(spark, d)))


@query(f"""WITH {SHIP}, x AS (SELECT key, y, ds, lag(y) OVER w AS p, lag(y, 2) OVER w AS yhat, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM ship WINDOW w AS (PARTITION BY key ORDER BY ds, l_orderkey, l_linenumber, l_partkey, l_suppkey)),
g AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE coalesce(sign(yhat - p) * (y / p - 1), 0) END AS pnl FROM x),
e AS (SELECT *, sum(pnl) OVER w AS eq FROM g WINDOW w AS (PARTITION BY key ORDER BY ds, l_orderkey, l_linenumber, l_partkey, l_suppkey)),
q AS (SELECT *, greatest(max(eq) OVER w, 0) AS peak FROM e WINDOW w AS (PARTITION BY key ORDER BY ds, l_orderkey, l_linenumber, l_partkey, l_suppkey))
SELECT key, {r('sum(pnl)', 3)} AS total_pnl, {r('avg(pnl) / stddev_samp(pnl) * sqrt(252)', 3)} AS sharpe, {r('max(peak - eq)', 3)} AS max_drawdown
FROM q GROUP BY 1""", digits=3)
def strategy_hot_keys(spark, d):
    """The strategy over raw rows: lags, running equity and running peak in segments."""
    s = planned(ship_rows(spark, d))
    s = s.on(windowed(s, 2, lambda w: {"yhat": F.lag("y", 2).over(w)}))
    return metrics.strategy_report(s)


@query(f"""WITH {NSUPP}, v AS (SELECT key, quarter(ds)::INTEGER AS version, yhat - y AS e FROM nv)
SELECT key, version, count(*) AS n, {r('avg(e)')} AS bias, {r('sqrt(avg(e * e))')} AS rmse FROM v GROUP BY 1, 2""")
def forecast_drift(spark, d):
    df = naive(supp_daily(spark, d)).df.withColumn("version", F.quarter("ds"))
    return metrics.forecast_drift(df)


# --- frames, cutoffs, folds ---------------------------------------------------------------------------


@query(f"""WITH {SUPP}, l AS (SELECT key, max(ds) AS last FROM supp GROUP BY 1)
SELECT key, {ts('ds')} AS ds, false AS is_future FROM supp UNION ALL
SELECT key, {ts('last + to_days(i::INT)')} AS ds, true FROM l, generate_series(1, 30) g(i)""")
def future_frame(spark, d):
    return cv.future_frame(supp_daily(spark, d), 30)


@query(f"""WITH {SUPP}, l AS (SELECT key, max(ds) AS last, arg_max(volume, ds) AS volume FROM supp GROUP BY 1)
SELECT key, {ts('last + to_days(i::INT)')} AS ds, {r('volume')} AS volume FROM l, generate_series(1, 14) g(i)""")
def carry_regressors(spark, d):
    s = supp_daily(spark, d)
    ahead = cv.future_frame(s, 14, include_history=False).drop("is_future")
    return cv.carry_regressors(s, ahead, ["volume"])


CUT_SQL = f"""WITH RECURSIVE {{cte}}, e AS (SELECT key, min(ds) AS lo, max(ds) AS hi FROM {{t}} GROUP BY 1),
c(key, lo, cutoff) AS (
  SELECT key, lo, hi - to_days({{h}}) FROM e WHERE hi - to_days({{h}}) >= lo + to_days({{i}})
  UNION ALL
  SELECT key, lo, cutoff FROM (SELECT c.key, c.lo, CASE
      WHEN EXISTS (SELECT 1 FROM {{t}} x WHERE x.key = c.key AND x.ds > c.cutoff - to_days({{p}})
                   AND x.ds <= c.cutoff - to_days({{p}}) + to_days({{h}})) THEN c.cutoff - to_days({{p}})
      ELSE (SELECT max(ds) FROM {{t}} x WHERE x.key = c.key AND x.ds <= c.cutoff - to_days({{p}})) - to_days({{h}}) END AS cutoff
    FROM c) n WHERE cutoff >= lo + to_days({{i}}))"""


@query(CUT_SQL.format(cte=SEG, t="seg", h=60, i=365, p=30) + f""" SELECT key, {ts('cutoff')} AS cutoff,
(60 * 86400000000)::BIGINT AS horizon_us FROM c""")
def cv_cutoffs(spark, d):
    return cv.cv_cutoffs(seg_daily(spark, d), "365 days", "30 days", "60 days")


GAP_CTE = SUPP + ", late AS (SELECT * FROM supp WHERE month(ds) IN (1, 2, 7, 8, 9))"


@query(CUT_SQL.format(cte=GAP_CTE, t="late", h=40, i=400, p=25) + f""" SELECT key, {ts('cutoff')} AS cutoff,
(40 * 86400000000)::BIGINT AS horizon_us FROM c""")
def cv_cutoffs_with_gaps(spark, d):
    """Seasonal series: cutoffs jump over gaps longer than the horizon."""
    s = supp_daily(spark, d)
    s = s.filtered(s.df.filter(F.month("ds").isin(1, 2, 7, 8, 9)))
    return cv.cv_cutoffs(s, "400 days", "25 days", "40 days")


@query(f"""WITH {SEG}, e AS (SELECT key, min(ds) AS lo, max(ds) AS hi, count(*) AS n FROM seg GROUP BY 1),
h AS (SELECT *, greatest(least(n // 5, 30), 7)::INT AS h FROM e),
p AS (SELECT *, greatest(n // 2, 3 * h)::INT AS i, greatest(h // 10, 1)::INT AS p FROM h),
c AS (SELECT key, lo, i, h, unnest(generate_series(hi - to_days(h), lo + to_days(i), -to_days(p))) AS cutoff FROM p)
SELECT key, count(*) AS n, {ts('min(cutoff)')} AS first, {ts('max(cutoff)')} AS last,
(min(h) * 86400000000)::BIGINT AS horizon_us FROM c GROUP BY 1""")
def data_driven_cutoffs(spark, d):
    cuts = cv.data_driven_cutoffs(seg_daily(spark, d))
    return cuts.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("cutoff").alias("first"), F.max("cutoff").alias("last"),
        F.min("horizon_us").alias("horizon_us"),
    )


@query(CUT_SQL.format(cte=SEG, t="seg", h=60, i=365, p=90) + f""" SELECT c.key AS key, {ts('cutoff')} AS cutoff,
count(*) FILTER (WHERE ds <= cutoff) AS n_train, count(*) FILTER (WHERE ds > cutoff) AS n_test
FROM c JOIN seg ON seg.key = c.key AND seg.ds <= c.cutoff + to_days(60) GROUP BY 1, cutoff""")
def cv_folds(spark, d):
    s = seg_daily(spark, d)
    out = cv.folds(s, cv.cv_cutoffs(s, "365 days", "90 days", "60 days"))
    return out.groupBy("key", "cutoff").agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test")
    )


@query(f"""WITH {SUPP}, l AS (SELECT key, max(ds) AS last FROM supp GROUP BY 1)
SELECT key, {ts('last - to_days(30 * i::INT)')} AS cutoff, (30 * 86400000000)::BIGINT AS horizon_us
FROM l, generate_series(1, 3) g(i)""")
def backtest_cutoffs(spark, d):
    return cv.backtest_cutoffs(supp_daily(spark, d))


def _naive_cv(s: Series) -> "F.DataFrame":
    """Cross-validation rows whose forecast is the mean of the fold's training rows."""
    rows = cv.folds(s, cv.cv_cutoffs(s, "365 days", "120 days", "30 days"))
    mean = rows.filter("is_train").groupBy("key", "cutoff").agg(F.avg("y").alias("yhat"))
    test = rows.filter(~F.col("is_train")).join(mean, ["key", "cutoff"])
    return test.select(
        "key", "ds", "cutoff", "y", "yhat", (F.col("yhat") * 0.5).alias("yhat_lower"),
        (F.col("yhat") * 1.5).alias("yhat_upper"),
    )


NCV = CUT_SQL.format(cte=SEG, t="seg", h=30, i=365, p=120) + """, fold AS (
  SELECT c.key, cutoff, ds, y, ds <= cutoff AS tr FROM c JOIN seg ON seg.key = c.key AND seg.ds <= c.cutoff + to_days(30)),
mn AS (SELECT key, cutoff, avg(y) AS yhat FROM fold WHERE tr GROUP BY 1, 2),
cvr AS (SELECT f.key, ds, f.cutoff, y, yhat, epoch_us(ds) - epoch_us(f.cutoff) AS h
  FROM fold f JOIN mn ON mn.key = f.key AND mn.cutoff = f.cutoff WHERE NOT tr),
x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, ds) AS rn, count(*) OVER (PARTITION BY key) AS n FROM cvr),
g AS (SELECT key, h, min(rn) AS r0, max(rn) AS r1, count(*) AS c, min(n) AS n,
  avg(pow(y - yhat, 2)) AS mse, avg(abs(y - yhat)) AS mae, avg(abs((y - yhat) / y)) AS mape,
  avg(abs(y - yhat) / ((abs(y) + abs(yhat)) / 2)) AS smape, avg((y BETWEEN yhat * 0.5::DOUBLE AND yhat * 1.5::DOUBLE)::INT) AS cov
  FROM x GROUP BY 1, 2),
w AS (SELECT key, h, r0, r1, greatest(floor(n * 0.1::DOUBLE), 1) AS w FROM g),
o AS (SELECT w.key, w.h, w.w, greatest(least(g.r1, w.r1) - greatest(g.r0 - 1, w.r1 - w.w), 0) AS k, g.*
  EXCLUDE (key, h) FROM w JOIN g ON g.key = w.key AND g.h <= w.h WHERE w.r1 >= w.w),
md AS (SELECT w.key, w.h, quantile_cont(abs((y - yhat) / y), 0.5) AS mdape FROM w JOIN x ON x.key = w.key
  AND x.rn <= w.r1 AND x.rn >= least(w.r0, w.r1 - w.w + 1) WHERE w.r1 >= w.w GROUP BY 1, 2)"""


@query(NCV + f""" SELECT o.key AS key, o.h AS horizon, {r('sum(k * mse) / min(w) / 1e6', 2)} AS mse,
{r('sqrt(sum(k * mse) / min(w))', 2)} AS rmse, {r('sum(k * mae) / min(w)', 2)} AS mae, {r('sum(k * mape) / min(w)', 2)} AS mape,
{r('min(mdape)', 2)} AS mdape, {r('sum(k * smape) / min(w)', 2)} AS smape, {r('sum(k * cov) / min(w)', 2)} AS coverage
FROM o JOIN md ON md.key = o.key AND md.h = o.h GROUP BY 1, 2""", digits=2)
def performance_metrics(spark, d):
    out = metrics.performance_metrics(_naive_cv(seg_daily(spark, d)))
    return out.withColumn("mse", F.col("mse") / 1e6)  # in millions, within double precision


GRID_PARAMS = {"lag": (1.0, 7.0, 14.0), "shrink": (0.0, 0.5, 1.0)}


def _toy_scores(s: Series):
    """RMSE per key and parameter set of a shrunken lag forecast: a grid that SQL can search."""
    lags = windowed(s, 14, lambda w: {f"l{n}": F.lag("y", n).over(w) for n in (1, 7, 14)})
    lags = lags.join(lags.groupBy("key").agg(F.avg("y").alias("m")), "key")
    every = F.broadcast(cv.param_grid(s.df.sparkSession, GRID_PARAMS))  # nine rows, set above
    picked = F.when(F.col("lag") == 1, F.col("l1")).when(F.col("lag") == 7, F.col("l7")).otherwise(F.col("l14"))
    yhat = (1 - F.col("shrink")) * picked + F.col("shrink") * F.col("m")
    rows = lags.filter("l14 IS NOT NULL").crossJoin(every)
    err = F.col("y") - yhat
    return rows.groupBy("key", "param_id", "lag", "shrink").agg(F.sqrt(F.avg(err * err)).alias("rmse"))


TOY = f"""{SEG}, m AS (SELECT key, avg(y) AS m FROM seg GROUP BY 1),
l AS (SELECT key, y, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7, lag(y, 14) OVER w AS l14
  FROM seg WINDOW w AS (PARTITION BY key ORDER BY ds)),
p AS (SELECT (row_number() OVER (ORDER BY lag, shrink) - 1)::INTEGER AS param_id, lag, shrink
  FROM (VALUES (1.0::DOUBLE), (7.0), (14.0)) a(lag), (VALUES (0.0::DOUBLE), (0.5), (1.0)) b(shrink)),
sc AS (SELECT l.key, param_id, lag, shrink, sqrt(avg(pow(y - ((1 - shrink) * CASE lag WHEN 1 THEN l1 WHEN 7 THEN l7 ELSE l14 END + shrink * m), 2))) AS rmse
  FROM l JOIN m ON m.key = l.key CROSS JOIN p WHERE l14 IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {TOY} SELECT key, param_id, {r('lag')} AS lag, {r('shrink')} AS shrink, {r('rmse')} AS rmse FROM sc")
def param_grid_scores(spark, d):
    return _toy_scores(seg_daily(spark, d))


# The three lags tie at full shrinkage in exact arithmetic, so ranks use rounded scores.
@query(f"""WITH {TOY}, q AS (SELECT * REPLACE (round(rmse, 3) AS rmse) FROM sc),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rmse, param_id) AS rn FROM q)
SELECT key, param_id, {r('lag')} AS lag, {r('shrink')} AS shrink, {r('rmse')} AS rmse FROM b WHERE rn = 1""")
def best_params(spark, d):
    scores = _toy_scores(seg_daily(spark, d)).withColumn("rmse", F.round("rmse", 3))
    return metrics.best_params(scores, ["lag", "shrink"])


@query(f"""WITH {TOY}, v AS (SELECT key, 'lag' AS param, lag AS value, avg(rmse) AS m FROM sc GROUP BY 1, 2, 3
  UNION ALL SELECT key, 'shrink', shrink, avg(rmse) FROM sc GROUP BY 1, 2, 3),
z AS (SELECT key, param, coalesce(var_samp(m), 0) AS v FROM v GROUP BY 1, 2)
SELECT key, param, {r('v / sum(v) OVER (PARTITION BY key)')} AS importance FROM z""")
def param_importance(spark, d):
    return metrics.param_importance(_toy_scores(seg_daily(spark, d)), ["lag", "shrink"], keys=["key"])


# --- the forecaster --------------------------------------------------------------------------------------


def _wave(kind: str, name: str, period: float, k: int) -> str:
    angle = f"2 * pi() * (epoch_us(ds) / 86400000000.0::DOUBLE) / {period} * {k}"
    return f"{r(f'{kind}({angle})')} AS {name}_{kind}_{k}"


@query(f"""WITH {SEG}, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds) AS rn,
  count(*) OVER (PARTITION BY key) AS n, min(epoch_us(ds)) OVER (PARTITION BY key) AS t0,
  max(epoch_us(ds)) OVER (PARTITION BY key) AS t1, max(abs(y)) OVER (PARTITION BY key) AS y_scale FROM seg),
k AS (SELECT q.key, (epoch_us(ds) - t0)::DOUBLE / (t1 - t0) AS c FROM q
  JOIN generate_series(1, 25) g(j) ON rn = round_even(j * (floor(n * 0.8::DOUBLE) - 1) / 25, 0) + 1),
t AS (SELECT *, (epoch_us(ds) - t0)::DOUBLE / (t1 - t0) AS t FROM q)
SELECT t.key AS key, {ts('min(ds)')} AS ds, {r('min(y_scale)')} AS y_scale, {r('min(t.t)')} AS t,
{r('sum(greatest(t.t - c, 0))')} AS hinge_sum, {_wave('sin', 'weekly', 7.0, 1).replace('ds', 'min(ds)', 1)},
{_wave('cos', 'yearly', 365.25, 2).replace('ds', 'min(ds)', 1)}, {_wave('sin', 'yearly', 365.25, 10).replace('ds', 'min(ds)', 1)}
FROM t JOIN k ON k.key = t.key GROUP BY t.key, t.rn""")
def design_matrix(spark, d):
    """Scaled time, changepoint hinges (summed here) and seasonal waves."""
    s = seg_daily(spark, d)
    out = design.design_matrix(s, design.time_scales(s))
    hinge_sum = F.aggregate("hinges", F.lit(0.0), lambda a, v: a + v).alias("hinge_sum")
    return out.select("key", "ds", "y_scale", "t", hinge_sum, "weekly_sin_1", "yearly_cos_2", "yearly_sin_10")


@query(f"""WITH {SUPP} SELECT key, 'ok' AS status, count(*) AS n, {r('max(abs(y))')} AS y_scale, 27::INTEGER AS n_trend,
25::INTEGER AS n_cps, 34::INTEGER AS n_beta, true AS has_noise FROM supp GROUP BY 1""")
def fit_forecaster(spark, d):
    """Multiplicative forecaster of every supplier: one row of parameters per key."""
    p = fitting.fit(supp_daily(spark, d))
    return p.select(
        "key", "status", "n", "y_scale", F.size("trend").alias("n_trend"), F.size("cps").alias("n_cps"),
        F.size("beta").alias("n_beta"), (F.col("sigma") > 0).alias("has_noise"),
    )


ADDITIVE = design.ForecastOptions(seasonality_mode="additive")


@query(f"""WITH {SHIP} SELECT key, 'ok' AS status, count(*) AS n, {r('max(abs(y))')} AS y_scale, 34::INTEGER AS n_beta,
true AS has_noise FROM ship GROUP BY 1""")
def fit_forecaster_long(spark, d):
    """Additive forecaster from cross products: hot keys of any length, three raw series here."""
    p = fitting.fit_long(ship_rows(spark, d), ADDITIVE)
    return p.select(
        "key", "status", "n", "y_scale", F.size("beta").alias("n_beta"), (F.col("sigma") > 0).alias("has_noise")
    )


@query()
def fit_logistic(spark, d):
    s = seg_daily(spark, d)
    options = design.logistic_options()
    p = fitting.fit(s, options)
    ahead = s.reordered(cv.future_frame(s, 30, include_history=False), "ds", max_rows=30)
    return predicting.predict(p, ahead, options)


@query()
def forecast(spark, d):
    """History fit and 30 days ahead with intervals and components, for every supplier."""
    s = supp_daily(spark, d)
    p = fitting.fit(s)
    frame = s.reordered(cv.future_frame(s, 30).drop("is_future"), "ds", max_rows=s.max_rows + 30)
    return predicting.predict(p, frame)


@query()
def forecast_with_regressors(spark, d):
    """Volume as a regressor; future rows carry its last known value."""
    s = rev_daily(spark, d)
    options = design.ForecastOptions(regressors=("volume",))
    p = fitting.fit(s, options)
    ahead = cv.carry_regressors(s, cv.future_frame(s, 30, include_history=False).drop("is_future"), ["volume"])
    return predicting.predict(p, s.reordered(ahead, "ds", max_rows=30), options)


@query()
def forecast_custom_season(spark, d):
    """A custom monthly seasonality beside the automatic ones."""
    s = rev_daily(spark, d)
    options = design.ForecastOptions(
        yearly="auto", weekly="auto", daily="auto", custom=(design.Season("monthly", 30.5, 5),)
    )
    p = fitting.fit(s, options)
    ahead = s.reordered(cv.future_frame(s, 30, include_history=False).drop("is_future"), "ds", max_rows=30)
    return predicting.predict(p, ahead, options)


@query()
def cross_validate(spark, d):
    """Every fold of the year-on history: a cutoff each month, two months ahead."""
    s = seg_daily(spark, d)
    return tune.cross_validate(s, cv.cv_cutoffs(s, "365 days", "30 days", "60 days"))


FOLDS = CUT_SQL.format(cte=SEG, t="seg", h=60, i=365, p=30) + """, f AS (
  SELECT key, count(*) AS n_folds FROM c GROUP BY 1)"""


def _grid_sql(grid) -> str:
    """Every combination, numbered with the last parameter fastest."""
    values = {n: ", ".join(f"({v!r}{'' if isinstance(v, str) else '::DOUBLE'}, {i})" for i, v in enumerate(vs)) for n, vs in grid.items()}
    tables = ", ".join(f"(VALUES {v}) t{n}({n}, i_{n})" for n, v in values.items())
    number, size = "0", 1
    for n, vs in reversed(grid.items()):
        number, size = f"{number} + i_{n} * {size}", size * len(vs)
    return f"g AS (SELECT ({number})::INTEGER AS param_id, {', '.join(grid)} FROM {tables})"


def _scored(spark, d, grid):
    s = seg_daily(spark, d)
    cuts = cv.cv_cutoffs(s, "365 days", "30 days", "60 days")
    scores, best = tune.grid_search(s, cuts, grid)
    shown = scores.withColumn("has_score", F.col("rmse") > 0).select("key", "param_id", *grid, "n_folds", "has_score")
    return shown, best


@query(f"""{FOLDS}, {_grid_sql(cv.TRAINER_GRID)} SELECT key, param_id, {r('changepoint_prior_scale')} AS changepoint_prior_scale,
{r('seasonality_prior_scale')} AS seasonality_prior_scale, {r('holidays_prior_scale')} AS holidays_prior_scale, seasonality_mode,
n_folds, true AS has_score FROM f CROSS JOIN g""")
def grid_search_scores(spark, d):
    """The trainer's grid of 64 sets, each scored on every fold."""
    return _scored(spark, d, cv.TRAINER_GRID)[0]


@query(f"""{FOLDS}, {_grid_sql(cv.TUNER_GRID)} SELECT key, param_id, {r('changepoint_prior_scale')} AS changepoint_prior_scale,
{r('seasonality_prior_scale')} AS seasonality_prior_scale, {r('holidays_prior_scale')} AS holidays_prior_scale, seasonality_mode,
{r('changepoint_range')} AS changepoint_range, n_folds, true AS has_score FROM f CROSS JOIN g""")
def tuner_grid_scores(spark, d):
    """The tuner's grid of 512 sets, each scored on every fold."""
    return _scored(spark, d, cv.TUNER_GRID)[0]


@query()
def grid_search(spark, d):
    """The winner of the 64 sets per key, with its mean error."""
    return _scored(spark, d, cv.TRAINER_GRID)[1]


@query()
def end_to_end_forecast(spark, d):
    """Clean, indicators, features, fit with them on the first part, forecast and evaluate on the rest."""
    s = supp_daily(spark, d)
    return run_workflow(s, WorkflowConfig(periods=90))["metrics"]


@query(f"""WITH {NSUPP} SELECT key, {ts('ds')} AS ds, 'yhat' AS component, {r('yhat')} AS value FROM nv
UNION ALL SELECT key, {ts('ds')}, 'yhat_lower', {r('yhat_lower')} FROM nv
UNION ALL SELECT key, {ts('ds')}, 'yhat_upper', {r('yhat_upper')} FROM nv""")
def forecast_components(spark, d):
    return charts.forecast_components(naive(supp_daily(spark, d)).df)


@query(f"""WITH {NSUPP} SELECT key, {ts('ds')} AS ds, {r('yhat_upper')} AS bound, 0::INTEGER AS side, epoch_us(ds) AS ordinal FROM nv
UNION ALL SELECT key, {ts('ds')}, {r('yhat_lower')}, 1, -epoch_us(ds) FROM nv""")
def interval_polygon(spark, d):
    return charts.interval_polygon(naive(supp_daily(spark, d)).df)


@query(f"""WITH {NSUPP}, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds DESC) AS rn FROM nv WHERE ds > TIMESTAMP '2000-12-31')
SELECT key, {ts('ds')} AS ds, {r('yhat')} AS yhat, {r('yhat_lower')} AS yhat_lower, {r('yhat_upper')} AS yhat_upper FROM q WHERE rn <= 30""")
def forecast_report(spark, d):
    s = naive(supp_daily(spark, d))
    ends = s.df.groupBy("key").agg(F.lit("2000-12-31").cast("timestamp").alias("last_ds"))
    return predicting.report_table(s.df, ends, 30)


# --- ensembles ---------------------------------------------------------------------------------------------


def _base_predictions(s: Series) -> Series:
    """Three simple models in long form, with their actual values."""
    df = windowed(
        s, 14,
        lambda w: {
            "last": F.lag("y", 1).over(w), "week": F.lag("y", 7).over(w),
            "mean": F.avg("y").over(w.rowsBetween(-14, -1)),
        },
    ).filter("week IS NOT NULL")
    # An array of the models leaves rows with their key; an unpivot would forget where they are.
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat")) for m in ("last", "week", "mean")])
    long = df.select("key", "ds", "y", F.inline(each))
    return replace(s, df=long, keys=("key", "model"))


BASE = """bp AS (SELECT * FROM (SELECT key, ds, y, lag(y, 1) OVER w AS last, lag(y, 7) OVER w AS week,
    avg(y) OVER (PARTITION BY key ORDER BY ds ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS mean
  FROM {t} WINDOW w AS (PARTITION BY key ORDER BY ds)) WHERE week IS NOT NULL),
lp AS (SELECT key, ds, y, 'last' AS model, last AS yhat FROM bp UNION ALL SELECT key, ds, y, 'week', week FROM bp
  UNION ALL SELECT key, ds, y, 'mean', mean FROM bp)"""
BSUPP = SUPP + ", " + BASE.format(t="supp")


def _parts(spark, d):
    long = _base_predictions(supp_daily(spark, d))
    actual = long.df.filter("model = 'week'").select("key", "ds", "y")
    return long.on(long.df.drop("y")), actual


WEIGHTS = BSUPP + """, we AS (SELECT *, avg(abs(yhat - y)) OVER f AS mae, count(*) OVER f AS seen FROM lp
  WINDOW f AS (PARTITION BY key, model ORDER BY ds ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
dw AS (SELECT *, CASE WHEN seen < 30 THEN 1.0::DOUBLE / 3 ELSE (1 / mae) / sum(1 / mae) OVER (PARTITION BY key, ds) END AS weight FROM we)"""


@query(f"WITH {WEIGHTS} SELECT key, {ts('ds')} AS ds, model, {r('weight')} AS weight FROM dw")
def dynamic_weights(spark, d):
    long, actual = _parts(spark, d)
    return ensemble.dynamic_weights(long, actual).select("key", "ds", "model", "weight")


def _interval(yhat: str, sd: str = "stddev_samp(yhat)") -> str:
    return f"{r(yhat)} AS yhat, {r(f'{yhat} - 1.96 * {sd}')} AS yhat_lower, {r(f'{yhat} + 1.96 * {sd}')} AS yhat_upper"


def _interval3(yhat: str, sd: str) -> str:
    return f"{r(yhat, 3)} AS yhat, {r(f'{yhat} - 1.96 * {sd}', 3)} AS yhat_lower, {r(f'{yhat} + 1.96 * {sd}', 3)} AS yhat_upper"


@query(f"WITH {WEIGHTS} SELECT key, {ts('ds')} AS ds, {_interval('sum(weight * yhat)')} FROM dw GROUP BY key, ds")
def ensemble_dynamic(spark, d):
    long, actual = _parts(spark, d)
    return ensemble.predict_ensemble(long, "dynamic_weighted", actual)


@query(f"WITH {BSUPP} SELECT key, {ts('ds')} AS ds, {_interval('avg(yhat)')} FROM lp GROUP BY key, ds")
def ensemble_average(spark, d):
    return ensemble.predict_ensemble(_parts(spark, d)[0], "simple_average")


@query(f"""WITH {BSUPP}, e AS (SELECT key, model, sqrt(avg(pow(y - yhat, 2))) AS rmse FROM lp GROUP BY 1, 2),
wt AS (SELECT key, model, (1 / rmse) / sum(1 / rmse) OVER (PARTITION BY key) AS weight FROM e)
SELECT lp.key AS key, {ts('ds')} AS ds, {_interval('sum(weight * yhat)')}
FROM lp JOIN wt ON wt.key = lp.key AND wt.model = lp.model GROUP BY lp.key, ds""")
def ensemble_inverse_error(spark, d):
    long, actual = _parts(spark, d)
    return ensemble.predict_ensemble(long, "inverse_error", actual)


@query(f"""WITH {BSUPP}, c AS (SELECT key, count(*) * covar_pop(last, last) + 1 AS aa, count(*) * covar_pop(last, week) AS ab,
  count(*) * covar_pop(week, week) + 1 AS bb, count(*) * covar_pop(last, y) AS ay, count(*) * covar_pop(week, y) AS by_,
  avg(last) AS ma, avg(week) AS mb, avg(y) AS my FROM bp GROUP BY 1),
k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c)
SELECT bp.key AS key, {ts('ds')} AS ds,
{_interval3('(my - wa * ma - wb * mb + wa * last + wb * week)', '(abs(last - week) / sqrt(2.0::DOUBLE))')}
FROM bp JOIN k ON k.key = bp.key""", digits=3)
def ensemble_stacking(spark, d):
    """Ridge on two model columns, against its closed form."""
    long, actual = _parts(spark, d)
    two = long.on(long.df.filter("model <> 'mean'"))
    return ensemble.predict_ensemble(two, "stacking", actual, models=["last", "week"])


@query(f"WITH {BSUPP} SELECT key, {ts('ds')} AS ds, {r('last')} AS last, {r('week')} AS week, {r('mean')} AS mean FROM bp")
def align_models(spark, d):
    """Long predictions to one column per model."""
    return ensemble.wide(_parts(spark, d)[0].df, ["last", "week", "mean"])


def _train_and_test(s: Series):
    split = features.split_train_test(s)
    return (
        s.filtered(split.df.filter("is_train").drop("is_train")),
        s.filtered(split.df.filter(~F.col("is_train")).drop("is_train")),
    )


@query()
def exp_smoothing(spark, d):
    train, test = _train_and_test(supp_daily(spark, d))
    return ensemble.exp_smoothing(train, test.df)


@query()
def boosted_trees(spark, d):
    train, test = _train_and_test(seg_daily(spark, d))
    return ensemble.tree_model(train, test, "boosted")


@query()
def random_forest(spark, d):
    train, test = _train_and_test(seg_daily(spark, d))
    return ensemble.tree_model(train, test, "forest")


@query()
def ensemble_models(spark, d):
    """All base models trained on one part, averaged on the rest, evaluated."""
    train, test = _train_and_test(seg_daily(spark, d))
    combined = ensemble.predict_ensemble(ensemble.train_base_models(train, test), "simple_average")
    return metrics.evaluate_ensemble(metrics.with_actual(combined, test.df))


@query(f"""WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds) AS i, count(*) OVER (PARTITION BY key) AS n FROM seg)
SELECT key, {ts('ds')} AS ds, model, true AS answered FROM n, (VALUES ('forecaster'), ('exp_smoothing'), ('boosted'), ('forest')) m(model)
WHERE i > floor(n * (1 - 0.2::DOUBLE))""")
def base_models(spark, d):
    """Every base model answers for every row of the test part."""
    train, test = _train_and_test(seg_daily(spark, d))
    out = ensemble.train_base_models(train, test, rounds=20)
    return out.df.select("key", "ds", "model", (F.col("yhat").isNotNull() & ~F.isnan("yhat")).alias("answered"))


@query()
def feature_components(spark, d):
    """Principal components of the rolling features, summed up per component."""
    from tidemark.operators.reduce import principal_components

    s = features.rolling_columns(seg_daily(spark, d), (7, 30), ("mean", "std", "min", "max"))
    s = s.filtered(s.df.na.drop("any"))
    cols = [c for c in s.df.columns if c.startswith("rolling_")]
    out = principal_components(s, cols, 3)
    return out.groupBy("key").agg(*[F.stddev_pop(f"pc_{i}").alias(f"spread_{i}") for i in (1, 2, 3)])


@query(f"""WITH {GAPPY}, v AS (SELECT key, ds, y, CASE WHEN volume > 20 THEN volume END AS volume FROM gappy),
m AS (SELECT avg(y) AS my, stddev_samp(y) AS sy, avg(volume) AS mv, stddev_samp(volume) AS sv, sign(corr(y, volume)) AS r FROM v),
z AS (SELECT key, ds, (y - my) / sy AS a, r * (volume - mv) / sv AS b FROM v, m)
SELECT key, {ts('ds')} AS ds, {r('CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a, 0) + coalesce(b, 0)) / sqrt(2) END')} AS pc_1,
{r('CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a, 0) - coalesce(b, 0)) / sqrt(2) END')} AS pc_2 FROM z""")
def components_over_gaps(spark, d):
    """Two columns with gaps have components in closed form, and every row keeps its place."""
    from tidemark.operators.reduce import principal_components

    s = supp_gappy(spark, d)
    s = s.on(s.df.withColumn("volume", F.when(F.col("volume") > 20, F.col("volume"))))
    return principal_components(s, ["y", "volume"], 2).select("key", "ds", "pc_1", "pc_2")


@query(f"""WITH {BARS}, m AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 8400 DAY AS ds, sum(o_totalprice) AS macro FROM orders GROUP BY 1)
SELECT b.key AS key, {ts('b.ds')} AS ds, {r('any_value(b."Close")')} AS "Close", {r('arg_max(m.macro, m.ds)')} AS macro
FROM bars b LEFT JOIN m ON m.ds <= b.ds GROUP BY b.key, b.ds""")
def enrich_as_of(spark, d):
    """The last known value of another (daily, shifted) series on every bar."""
    from tidemark.operators.enrich import as_of

    day = F.date_trunc("day", "o_orderdate") + F.expr("INTERVAL 8400 DAY")
    macro = table(spark, d, "orders").groupBy(day.alias("ds")).agg(F.sum("o_totalprice").alias("macro"))
    return as_of(event_bars(spark, d), macro, ["macro"]).select("key", "ds", "Close", "macro")


# --- versions --------------------------------------------------------------------------------------------


def _catalogue(spark, d):
    """A catalogue with one version per order priority and month."""
    orders = table(spark, d, "orders")
    month = F.date_trunc("month", "o_orderdate")
    rows = orders.groupBy(F.col("o_orderpriority").alias("prefix"), month.alias("month")).agg(
        F.max("o_orderdate").alias("created")
    )
    version = ((F.year("month") - 1995) * 12 + F.month("month")).cast("int")
    return rows.select(
        F.lit("data").alias("category"), F.lit("interim").alias("subcategory"), "prefix",
        version.alias("version"),
        F.concat("prefix", F.lit("_v"), F.lpad(version.cast("string"), 3, "0")).alias("version_id"),
        "created", F.lit("{}").alias("metadata"),
    )


CATALOGUE = """ct AS (SELECT DISTINCT 'data' AS category, 'interim' AS subcategory, o_orderpriority AS prefix,
  ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INTEGER AS version,
  o_orderpriority || '_v' || lpad(((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::VARCHAR, 3, '0') AS version_id
  FROM orders)"""


@query(f"WITH {CATALOGUE} SELECT category, subcategory, prefix, arg_max(version_id, version) AS version_id, max(version) AS version FROM ct GROUP BY 1, 2, 3")
def latest_version(spark, d):
    return versions.newest_versions(_catalogue(spark, d))


@query(f"""WITH {CATALOGUE} SELECT category, subcategory, prefix, version_id,
row_number() OVER (PARTITION BY prefix ORDER BY version)::INTEGER AS position FROM ct""")
def list_versions(spark, d):
    return versions.list_versions(_catalogue(spark, d))


@query(f"""WITH {CATALOGUE}, q AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY version DESC) AS rn FROM ct)
SELECT prefix, version_id FROM q WHERE rn > 5""")
def expired_versions(spark, d):
    return versions.expired_versions(_catalogue(spark, d)).select("prefix", "version_id")


@query(f"""WITH {CATALOGUE}, q AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY version DESC) AS rn FROM ct)
SELECT prefix, version_id FROM q WHERE rn <= 5""")
def kept_versions(spark, d):
    return versions.kept_versions(_catalogue(spark, d)).select("prefix", "version_id")


def _store(spark) -> versions.VersionStore:
    """A store of its own for each run, in the shared folder."""
    return versions.VersionStore(spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}")


@query(f"WITH {SUPP} SELECT key, {ts('ds')} AS ds, {r('y')} AS y, {r('volume')} AS volume FROM supp")
def save_and_load_version(spark, d):
    store = _store(spark)
    store.save(supp_daily(spark, d).df.filter("y > 0"), "data", "interim", "cleaned_data", {"step": 1})
    store.save(supp_daily(spark, d).df, "data", "interim", "cleaned_data", {"step": 2})
    return store.load("data", "interim", "cleaned_data")


@query(f"WITH {SUPP} SELECT key, {ts('ds')} AS ds, {r('y')} AS y FROM supp")
def features_fallback(spark, d):
    """No indicator frame was saved, so the newest cleaned frame is loaded."""
    store = _store(spark)
    store.save(supp_daily(spark, d).df.select("key", "ds", "y"), "data", "interim", "cleaned_data")
    return store.load_latest_features()


@query(f"WITH {SUPP} SELECT key, {ts('ds')} AS ds, {r('lag(y, 1) OVER w')} AS y_lag_1, {r('lag(y, 7) OVER w')} AS y_lag_7 FROM supp WINDOW w AS (PARTITION BY key ORDER BY ds)")
def save_and_load_features(spark, d):
    """Lag features are saved by kind and read back."""
    store = _store(spark)
    lagged = features.add_lags(supp_daily(spark, d), (1, 7), drop_rows=False)
    version = store.save_features(lagged.df.select("key", "ds", "y_lag_1", "y_lag_7"), "lag")
    return store.load("data", "features", version=version)


@query()
def save_and_load_model(spark, d):
    """Fitted parameters survive the round trip and still forecast."""
    store = _store(spark)
    s = seg_daily(spark, d)
    store.save_model(fitting.fit(s), metadata={"mode": "multiplicative"})
    ahead = s.reordered(cv.future_frame(s, 30, include_history=False).drop("is_future"), "ds", max_rows=30)
    return predicting.predict(store.load_model(), ahead)


@query(f"WITH {REV} SELECT key, {ts('ds')} AS ds, {r('y')} AS y FROM rev")
def csv_round_trip(spark, d):
    """CSV sink and source."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/csv"
    src.write_csv(rev_daily(spark, d).df.select("key", "ds", "y"), path)
    return src.load_csv(spark, path, key="key").select("key", "ds", "y")


@query("SELECT event_id, event_type AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ds, " + r("value") + " AS y, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_round_trip(spark, d):
    """Landed JSON, with an explicit schema."""
    from pyspark.sql import types as T

    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/json"
    ev = table(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    ev.select("event_id", F.col("event_type").alias("key"), F.col("ts").alias("ds"), F.col("value").alias("y"), k.alias("k")).write.json(path)
    schema = T.StructType.fromDDL("event_id bigint, key string, ds timestamp, y double, k bigint")
    return src.load_json(spark, path, schema)

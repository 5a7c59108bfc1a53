"""Fits and forecasts checked by value: the target is a known function of time, on the dates of the tables.

Weekly effects are whole steps per weekday, which six waves express exactly, and targets are whole
numbers, so that a good fit gives them back after rounding. ``DAY`` 0 is the first of 1995.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.datasets import rev_daily, seg_daily, ship_rows, supp_daily
from catalog.forecast_queries import _store
from catalog.registry import query, ts
from tidemark.models import cv, design, ensemble
from tidemark.models import fit as fitting
from tidemark.models import predict as predicting
from tidemark.plans.segments import numbered, planned
from tidemark.plans.series import Series

DAY = "datediff({ds}, DATE '1995-01-01')"
# Effects by day number modulo 7; both sum to zero.
SHARES = (-0.5, 0.5, 0.0, 0.0, 0.5, -0.5, 0.0)
STEPS = (300, -200, 100, 0, -300, 200, -100)


def _by_weekday(values, k: str) -> str:
    return "(CASE " + " ".join(f"WHEN {k} % 7 = {i} THEN {v}" for i, v in enumerate(values)) + " END)"


def product(k: str) -> str:
    return f"(200 + 2 * {k}) * (1 + {_by_weekday(SHARES, k)})"


def total(k: str) -> str:
    return f"2000 + 3 * {k} + {_by_weekday(STEPS, k)}"


def known(s: Series, formula, y: str = "y") -> Series:
    """The rows of ``s`` with a target that is a formula of the day."""
    k = F.expr(DAY.format(ds=f"CAST({s.ds} AS DATE)")).cast("int").alias("_k")
    rows = s.df.select("*", k)
    return s.on(rows.withColumn(y, F.expr(formula("_k")).cast("double")).drop("_k"))


def ahead(s: Series, periods: int = 30, regressors=()) -> Series:
    rows = cv.future_frame(s, periods, include_history=False).drop("is_future")
    if regressors:
        rows = cv.carry_regressors(s, rows, regressors)
    return s.reordered(rows, "ds", max_rows=periods)


def whole(df: DataFrame, *more: str) -> DataFrame:
    return df.select("key", "ds", F.round("yhat").cast("long").alias("yhat"), *more)


def _days(t: str, key: str, ds: str) -> str:
    return f"SELECT DISTINCT CAST({key} AS VARCHAR) AS key, date_trunc('day', {ds})::TIMESTAMP AS ds FROM {t}"


def _shown(dates: str, formula) -> str:
    k = "date_diff('day', DATE '1995-01-01', ds::DATE)"
    return f"SELECT key, {ts('ds')} AS ds, CAST(round({formula(k)}) AS BIGINT) AS yhat FROM ({dates})"


def _next(dates: str, periods: int = 30) -> str:
    return f"""SELECT key, last + j * INTERVAL 1 DAY AS ds FROM (SELECT key, max(ds) AS last FROM ({dates}) GROUP BY key)
CROSS JOIN generate_series(1, {periods}) g(j)"""


SHIP_DAYS = _days("lineitem", "l_returnflag", "l_shipdate")
SUPP_DAYS = _days("lineitem", "l_suppkey", "l_shipdate")
SEG_DAYS = _days("orders JOIN customer ON o_custkey = c_custkey", "c_mktsegment", "o_orderdate")
PLAIN = dict(yearly=False, daily=False)


@query(_shown(SUPP_DAYS, product))
def fit_recovered(spark, d):
    """The default multiplicative forecaster on every supplier's days, fitted values."""
    s = known(supp_daily(spark, d), product)
    o = design.ForecastOptions(**PLAIN)
    return whole(predicting.predict(fitting.fit(s, o), s, o))


@query(_shown(_next(SEG_DAYS), product))
def forecast_recovered(spark, d):
    """Thirty days ahead of a multiplicative fit."""
    s = known(seg_daily(spark, d), product)
    o = design.ForecastOptions(**PLAIN)
    return whole(predicting.predict(fitting.fit(s, o), ahead(s), o))


@query(_shown(_days("lineitem", "l_returnflag", "l_shipdate"), total))
def fit_additive_recovered(spark, d):
    """An additive fit with the automatic choice of seasons."""
    s = known(rev_daily(spark, d), total)
    o = design.ForecastOptions(seasonality_mode="additive", yearly=False, weekly="auto", daily="auto")
    return whole(predicting.predict(fitting.fit(s, o), s, o))


@query(_shown(SHIP_DAYS, total))
def fit_long_additive_recovered(spark, d):
    """Raw line items of three hot keys, additive: one pass of cross products."""
    s = known(ship_rows(spark, d), total)
    o = design.ForecastOptions(seasonality_mode="additive", yearly=False, weekly="auto", daily="auto")
    return whole(predicting.predict(fitting.fit_long(s, o), _each_day(s), o))


@query(_shown(SHIP_DAYS, product))
def fit_forecaster_long_multiplicative(spark, d):
    """Raw line items of three hot keys, multiplicative: distributed Gauss-Newton steps."""
    s = known(ship_rows(spark, d), product)
    o = design.ForecastOptions(**PLAIN)
    return whole(predicting.predict(fitting.fit_long(s, o), _each_day(s), o))


def _each_day(s: Series) -> Series:
    days = s.df.select("key", F.date_trunc("day", "ds").alias("ds")).distinct()
    return s.reordered(days, "ds", max_rows=10_000)


CURVE = "1000.0 / (1 + exp(3 - {k} / 400.0))"


@query(f"""WITH v AS (SELECT l_returnflag AS key, l_shipdate AS ds,
  {CURVE.format(k="date_diff('day', DATE '1995-01-01', l_shipdate::DATE)")} AS y FROM lineitem),
s AS (SELECT key, max(y) + 2 * stddev_samp(y) AS cap FROM v GROUP BY key)
SELECT v.key, CAST(year(ds) AS INTEGER) AS year, CAST(round(any_value(cap)) AS BIGINT) AS cap, count(*) AS n,
       CAST(round(avg(y)) AS BIGINT) AS yhat FROM v JOIN s ON s.key = v.key GROUP BY v.key, year(ds)""")
def fit_logistic_long(spark, d):
    """A saturating target of raw line items: the cap, and the fitted mean of every year."""
    s = known(ship_rows(spark, d), lambda k: CURVE.format(k=k))
    o = design.logistic_options(yearly=False, weekly=False, daily=False)
    params = fitting.fit_long(s, o)
    fitted = predicting.predict(params, _each_day(s), o).select("key", "ds", "yhat")
    rows = s.df.select("key", F.date_trunc("day", "ds").alias("ds")).groupBy("key", "ds").agg(F.count(F.lit(1)).alias("n"))
    years = rows.join(fitted, ["key", "ds"]).groupBy("key", F.year("ds").alias("year")).agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("yhat")) / F.sum("n")).cast("long").alias("yhat")
    )
    cap = F.round(F.col("cap") * F.col("y_scale")).cast("long").alias("cap")
    return years.join(params.select("key", cap), "key").select("key", "year", "cap", "n", "yhat")


@query(f"""WITH v AS (SELECT DISTINCT l_returnflag AS key, date_trunc('day', l_shipdate)::TIMESTAMP AS ds FROM lineitem),
q AS (SELECT l_returnflag AS key, date_trunc('day', l_shipdate)::TIMESTAMP AS ds, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)
SELECT v.key, {ts('v.ds')} AS ds, CAST(round({total("date_diff('day', DATE '1995-01-01', v.ds::DATE)")} + 2 * volume) AS BIGINT) AS yhat
FROM v JOIN q ON q.key = v.key AND q.ds = v.ds""")
def regressor_recovered(spark, d):
    """A target that moves with a regressor."""
    s = known(rev_daily(spark, d), total)
    s = s.on(s.df.withColumn("y", F.col("y") + 2 * F.col("volume")))
    o = design.ForecastOptions(seasonality_mode="additive", regressors=("volume",), **PLAIN)
    return whole(predicting.predict(fitting.fit(s, o), s, o))


def five(k: str) -> str:
    return f"2000 + 3 * {k} + CASE WHEN {k} % 5 = 0 THEN 400 WHEN {k} % 5 = 3 THEN -400 ELSE 0 END"


@query(_shown(SEG_DAYS, five))
def custom_season_recovered(spark, d):
    """A five-day season as a custom one beside the weekly one."""
    s = known(seg_daily(spark, d), five)
    o = design.ForecastOptions(seasonality_mode="additive", custom=(design.Season("five", 5.0, 2),), **PLAIN)
    return whole(predicting.predict(fitting.fit(s, o), s, o))


@query(_shown(_next(SEG_DAYS), product))
def stored_model_recovered(spark, d):
    """A fitted model is saved, loaded and forecasts."""
    s = known(seg_daily(spark, d), product)
    o = design.ForecastOptions(**PLAIN)
    store = _store(spark)
    store.save_model(fitting.fit(s, o), metadata={"mode": "multiplicative"})
    return whole(predicting.predict(store.load_model(), ahead(s), o))


@query(_shown(_next(SEG_DAYS), total))
def exp_smoothing_recovered(spark, d):
    """Smoothing of a straight line with a weekly season, on every day, goes on without error."""
    s = seg_daily(spark, d)
    spans = s.df.groupBy("key").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    every = known(s.on(spans.select("key", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 DAY)")).alias("ds"))), total)
    return whole(ensemble.exp_smoothing(every, ahead(every).df, period=7))


def steps(k: str) -> str:
    return f"CASE {k} % 10 WHEN 3 THEN 500 WHEN 6 THEN 900 WHEN 7 THEN 900 WHEN 8 THEN 900 WHEN 9 THEN 900 ELSE 100 END"


@query(_shown(SEG_DAYS, steps))
def tree_regressor_recovered(spark, d):
    """Boosted trees find a step function of a column, and of where it is missing."""
    s = known(seg_daily(spark, d), steps)
    k = F.expr(DAY.format(ds="CAST(ds AS DATE)")) % 10
    text = F.when(k >= 6, "late").otherwise("early")
    s = s.on(s.df.select("key", "ds", "y", F.when(k != 3, k).cast("double").alias("x"), text.alias("part")))
    return whole(ensemble.tree_model(s, s))


def by_row(i: str) -> str:
    return f"1000 + 2 * {i} + {_by_weekday(STEPS, i)}"


@query(f"""SELECT l_returnflag AS key, {ts('max(l_shipdate) + j * INTERVAL 1 DAY')} AS ds, CAST({by_row('(any_value(n) + j - 1)')} AS BIGINT) AS yhat
FROM (SELECT l_returnflag, l_shipdate, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), generate_series(1, 30) g(j)
GROUP BY l_returnflag, j""")
def exp_smoothing_long_recovered(spark, d):
    """Raw line items of three hot keys, in segments: a line with a season of seven rows goes on."""
    s = planned(ship_rows(spark, d))
    rows = numbered(s, "i").withColumn("i", F.col("i") - 1)
    s = s.on(rows.withColumn("y", F.expr(by_row("i")).cast("double")).drop("i"))
    return whole(ensemble.exp_smoothing(s, ahead(s).df, period=7))

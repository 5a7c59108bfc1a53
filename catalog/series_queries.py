"""Queries over sources, projections, windows and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.datasets import (
    BARS, EVENT, GAPPY, REV, SEG, SHIP, SUPP, event_bars, event_rows, rev_daily, seg_daily,
    ship_rows, supp_daily, supp_gappy, table,
)
from catalog.registry import query, r, ts
from tidemark.functions import calendar as cal
from tidemark.functions import scalars as sc
from tidemark.operators import clean, features, indicators
from tidemark.plans.segments import fill, numbered, planned, running
from tidemark.plans.series import normalise, strip_tz
from tidemark.sources import bars as src

BAR_COLS = """key, {t} AS ds, {o} AS "Open", {h} AS "High", {l} AS "Low", {c} AS "Close", {v} AS "Volume" """


def _bars_out(t="ds"):
    return BAR_COLS.format(
        t=ts(t), o=r('"Open"'), h=r('"High"'), l=r('"Low"'), c=r('"Close"'), v=r('"Volume"')
    )


# --- sources -----------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT {_bars_out()} FROM bars")
def make_bars_hourly(spark, d):
    return event_bars(spark, d).df


@query(f"""WITH b AS (
  SELECT event_type AS key, date_trunc('week', ts)::TIMESTAMP AS ds,
         arg_min(value, (ts, event_id)) AS "Open", max(value) AS "High", min(value) AS "Low",
         arg_max(value, (ts, event_id)) AS "Close", count(*)::DOUBLE AS "Volume"
  FROM events GROUP BY 1, 2) SELECT {_bars_out()} FROM b""")
def make_bars_weekly(spark, d):
    return event_bars(spark, d, "1wk").df


@query(f"""WITH b AS (
  SELECT event_type AS key,
         to_timestamp(floor(epoch_us(ts) / 900000000) * 900)::TIMESTAMP AS ds,
         arg_min(value, (ts, event_id)) AS "Open", max(value) AS "High", min(value) AS "Low",
         arg_max(value, (ts, event_id)) AS "Close", count(*)::DOUBLE AS "Volume"
  FROM events GROUP BY 1, 2) SELECT {_bars_out()} FROM b""")
def make_bars_quarter_hour(spark, d):
    return event_bars(spark, d, "15m").df


@query(f"""WITH {BARS}, c AS (
  SELECT key, date_trunc('day', ds)::TIMESTAMP AS ds, arg_min("Open", ds) AS "Open",
         max("High") AS "High", min("Low") AS "Low", arg_max("Close", ds) AS "Close",
         sum("Volume") AS "Volume"
  FROM bars GROUP BY key, date_trunc('day', ds)) SELECT {_bars_out()} FROM c""")
def resample_bars(spark, d):
    return src.resample_bars(event_bars(spark, d), "1d").df


@query("""WITH n AS (SELECT l_suppkey::VARCHAR AS key, count(*) AS c FROM lineitem GROUP BY 1),
k AS (SELECT key FROM n WHERE c >= 600)
SELECT k.key AS key, count(*) AS n_rows, """ + r("sum(l_extendedprice)", 2) + """ AS total
FROM lineitem JOIN k ON k.key = l_suppkey::VARCHAR GROUP BY 1""", digits=2)
def load_bars_min_points(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("key"), F.col("l_extendedprice").alias("y")
    )
    kept = src.enough_points(rows, min_points=600)
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("total"))


@query("""SELECT l_suppkey::VARCHAR AS key, count(*) AS n_rows, count(*) >= 600 AS enough
FROM lineitem GROUP BY 1""")
def point_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"))
    return src.point_counts(rows, min_points=600)


@query(f"""SELECT o_orderstatus AS key, count(*) AS n, {ts('min(o_orderdate)')} AS first,
{ts('max(o_orderdate)')} AS last FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-07-02' AND o_orderdate < TIMESTAMP '2001-07-02' GROUP BY 1""")
def date_range(spark, d):
    """The default look-back of 365 days before an end date."""
    rows = src.date_range(table(spark, d, "orders"), end="2001-07-02", ds="o_orderdate")
    return rows.groupBy(F.col("o_orderstatus").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last"),
    )


@query(f"WITH {BARS} SELECT key, {ts('ds')} AS ds, {r('\"Close\"')} AS y FROM bars")
def to_series(spark, d):
    """No 'Adj Close' here, so the target falls back to Close."""
    out = src.to_series(event_bars(spark, d).df, ts="ds")
    return out.select("key", "ds", "y")


@query(f"""WITH {GAPPY} SELECT key, count(*) AS n_rows, count(*) - count(y) AS n_missing
FROM gappy GROUP BY 1""")
def missing_targets(spark, d):
    return src.missing_targets(supp_gappy(spark, d).df)


@query(f"""WITH {BARS} SELECT key, {ts('ds')} AS ds, {r('"Open"')} AS y, {r('"Open"')} AS "Close" FROM bars""")
def target_to_close(spark, d):
    """A cleaned target (here the opening price) replaces Close."""
    bars = event_bars(spark, d).df.withColumn("y", F.col("Open"))
    return src.target_to_close(bars).select("key", "ds", "y", "Close")


@query(f"""WITH {GAPPY} SELECT key, count(*) AS n_rows, 0::BIGINT AS bad_dates,
count(*) - count(y) AS missing_y, count(*) < 30 AS too_few, max(y) - min(y) > 100000 AS wide_range
FROM gappy GROUP BY 1""")
def load_checks(spark, d):
    return src.load_checks(supp_gappy(spark, d).df, max_range=100_000)


@query("""SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS local_ts FROM events""")
def strip_tz_local(spark, d):
    """Wall-clock time of a zone (January, so five hours behind) without the zone."""
    ev = table(spark, d, "events").select("event_id", F.col("ts").alias("local_ts"))
    return strip_tz(ev, "local_ts", "America/New_York")


@query("""SELECT event_id, strftime(strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y'), '%Y-%m-%d %H:%M:%S') AS day,
CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y%m%d') END AS stamp,
{half} AS half, {clipped} AS clipped, {pct} AS pct
FROM events""".format(
    half=r("CASE WHEN event_id % 7 <> 0 THEN value / 2 END"),
    clipped=r("least(greatest(value, 5.0::DOUBLE), 60.0::DOUBLE)"),
    pct=r("CASE WHEN event_id % 7 <> 0 THEN 100 * abs(value - (event_id % 7)) / (event_id % 7) END"),
))
def scalar_functions(spark, d):
    """Date parsing with bad input, formatting, safe ratios, clipping and percent errors."""
    ev = table(spark, d, "events")
    step = F.pmod("event_id", F.lit(7)).cast("double")
    bad = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("not a date"))
    text = F.coalesce(bad, sc.format_date(F.col("ts"), "yyyyMMdd"))
    parsed = sc.parse_date(text, "yyyyMMdd")
    return ev.select(
        "event_id",
        sc.parse_date(sc.format_date(F.col("ts"), "dd/MM/yyyy"), "dd/MM/yyyy").alias("day"),
        sc.format_date(parsed, "yyyyMMdd").alias("stamp"),
        sc.ratio(F.col("value") * step, step * 2).alias("half"),
        sc.clip(F.col("value"), F.lit(5.0), F.lit(60.0)).alias("clipped"),
        sc.percent_error(step, F.col("value")).alias("pct"),
    )


# --- fills and gaps ----------------------------------------------------------------------------


def _filled(expr: str, cte: str, src_name: str) -> str:
    return f"WITH {cte} SELECT key, {ts('ds')} AS ds, {r(expr)} AS y FROM {src_name}"


@query(f"""WITH {GAPPY} SELECT key, {ts('ds')} AS ds,
{r('last_value(y IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds)')} AS y,
{r('last_value(volume IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds)')} AS volume FROM gappy""")
def forward_fill(spark, d):
    return clean.forward_fill(supp_gappy(spark, d)).df


@query(f"""WITH {GAPPY} SELECT key, {ts('ds')} AS ds,
{r('last_value(y IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds DESC)')} AS y,
{r('last_value(volume IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds DESC)')} AS volume FROM gappy""")
def backward_fill(spark, d):
    return clean.backward_fill(supp_gappy(spark, d)).df


INTERP = f"""WITH {GAPPY}, n AS (
  SELECT key, ds, y,
    last_value(CASE WHEN y IS NOT NULL THEN epoch_us(ds) END IGNORE NULLS) OVER a AS t0,
    last_value(y IGNORE NULLS) OVER a AS y0,
    last_value(CASE WHEN y IS NOT NULL THEN epoch_us(ds) END IGNORE NULLS) OVER b AS t1,
    last_value(y IGNORE NULLS) OVER b AS y1
  FROM gappy
  WINDOW a AS (PARTITION BY key ORDER BY ds), b AS (PARTITION BY key ORDER BY ds DESC))
SELECT key, {ts('ds')} AS ds, {r('''coalesce(y,
  CASE WHEN t1 > t0 THEN y0 + (epoch_us(ds) - t0)::DOUBLE / (t1 - t0)::DOUBLE * (y1 - y0) END,
  y0, y1)''')} AS y FROM n"""


@query(INTERP)
def interpolate_time(spark, d):
    s = supp_gappy(spark, d)
    return clean.interpolate(s.on(s.df.drop("volume"))).df


@query(f"""WITH {EVENT}, g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE y END AS z FROM ev)
SELECT key, event_id, {r('last_value(z IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds, event_id)')} AS filled,
{r('last_value(z IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds DESC, event_id DESC)')} AS next_known FROM g""")
def fill_hot_keys(spark, d):
    """Fills over raw events in segments: carries join the segments of a hot key."""
    s = planned(event_rows(spark, d))
    s = s.on(s.df.withColumn("z", F.when(F.pmod("event_id", F.lit(3)) != 0, F.col("y"))))
    out = s.on(fill(s, {"filled": F.col("z")}))
    out = fill(out, {"next_known": F.col("z")}, forward=False)
    return out.select("key", "event_id", "filled", "next_known")


@query(f"""WITH {SHIP} SELECT key, l_orderkey, l_linenumber,
row_number() OVER w AS rn, {r('sum(y) OVER w', 2)} AS total, {r('max(y) OVER w', 2)} AS peak
FROM ship WINDOW w AS (PARTITION BY key ORDER BY ds, l_orderkey, l_linenumber, l_partkey, l_suppkey)""", digits=2)
def running_hot_keys(spark, d):
    """Row numbers, running sums and running maxima of raw rows in segments."""
    s = planned(ship_rows(spark, d))
    s = s.on(numbered(s))
    out = running(s, sums={"total": F.col("y")}, maxima={"peak": F.col("y")})
    return out.select("key", "l_orderkey", "l_linenumber", "rn", "total", "peak")


# --- lags, rolling, calendar ---------------------------------------------------------------------


@query(f"""WITH {SUPP}, l AS (
  SELECT key, ds, y, volume, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7,
         lag(y, 14) OVER w AS l14, lag(y, 30) OVER w AS l30
  FROM supp WINDOW w AS (PARTITION BY key ORDER BY ds))
SELECT key, {ts('ds')} AS ds, {r('y')} AS y, {r('volume')} AS volume, {r('l1')} AS y_lag_1,
{r('l7')} AS y_lag_7, {r('l14')} AS y_lag_14, {r('l30')} AS y_lag_30
FROM l WHERE l30 IS NOT NULL AND y IS NOT NULL""")
def lag_features(spark, d):
    return features.add_lags(supp_daily(spark, d)).df


def _rolling_sql(cte: str, name: str, order: str, ids: str, windows=(7, 14, 30), digits=4) -> str:
    """Bias-corrected moments from the frame's population moments."""
    inner, outer, named = [], [], []
    for n in windows:
        f = f"w{n}"
        named.append(f"w{n} AS (PARTITION BY key ORDER BY {order} ROWS {n - 1} PRECEDING)")
        inner += [
            f"avg(y) OVER {f} AS rolling_mean_{n}", f"stddev_samp(y) OVER {f} AS rolling_std_{n}",
            f"min(y) OVER {f} AS rolling_min_{n}", f"max(y) OVER {f} AS rolling_max_{n}",
            f"list(y) OVER {f} AS v{n}",
        ]
        mean = f"list_avg(v{n})"
        m = f"len(v{n})"

        def moment(k, n=n, mean=mean):
            return f"list_avg(list_transform(v{n}, lambda x: pow(x - {mean}, {k})))"

        outer += [
            f"{m} AS m{n}", f"{moment(2)} AS a{n}", f"{moment(3)} AS b{n}", f"{moment(4)} AS c{n}",
        ]
    lines = [ids]
    for n in windows:
        lines += [f"{r(f'rolling_{k}_{n}', digits)} AS rolling_{k}_{n}" for k in ("mean", "std", "min", "max")]
        skew = f"""CASE WHEN m{n} < 3 THEN NULL WHEN rolling_min_{n} = rolling_max_{n} THEN 0
          ELSE b{n} / pow(a{n}, 1.5) * sqrt(m{n} * (m{n} - 1.0)) / (m{n} - 2) END"""
        kurt = f"""CASE WHEN m{n} < 4 THEN NULL WHEN rolling_min_{n} = rolling_max_{n} THEN -3
          ELSE ((m{n} + 1) * (c{n} / (a{n} * a{n}) - 3) + 6) * (m{n} - 1.0) / ((m{n} - 2.0) * (m{n} - 3.0)) END"""
        lines += [f"{r(skew, digits)} AS rolling_skew_{n}", f"{r(kurt, digits)} AS rolling_kurt_{n}"]
    return (
        f"WITH {cte}, f AS (SELECT *, {', '.join(inner)} FROM {name} WINDOW {', '.join(named)}), "
        f"g AS (SELECT *, {', '.join(outer)} FROM f) SELECT {', '.join(lines)} FROM g"
    )


@query(_rolling_sql(SEG, "seg", "ds", f"key, {ts('ds')} AS ds"))
def rolling_features(spark, d):
    """18 rolling columns in one window pass, before gaps are filled."""
    s = seg_daily(spark, d)
    return features.rolling_columns(s).df.drop("y", "volume")


@query(_rolling_sql(SHIP, "ship", "ds, l_orderkey, l_linenumber, l_partkey, l_suppkey", "key, l_orderkey, l_linenumber", (7,), 3), digits=3)
def rolling_hot_keys(spark, d):
    """Rolling columns over raw rows: hot keys in segments with copied look-back rows."""
    s = ship_rows(spark, d)
    return features.rolling_columns(s, windows=(7,)).df.drop("y", "ds", "l_partkey", "l_suppkey")


@query(f"""WITH {SUPP}, f AS (
  SELECT key, ds, avg(y) OVER w AS m, stddev_samp(y) OVER w AS sd, max(y) OVER w AS mx,
         skewness(y) OVER w AS sk, count(*) OVER w AS n
  FROM supp WINDOW w AS (PARTITION BY key ORDER BY ds ROWS 6 PRECEDING)),
g AS (SELECT key, stddev_samp(y) AS gsd FROM supp GROUP BY 1)
SELECT f.key AS key, {ts('ds')} AS ds, {r('m')} AS rolling_mean_7,
{r('coalesce(last_value(sd IGNORE NULLS) OVER (PARTITION BY f.key ORDER BY ds DESC), gsd)')} AS rolling_std_7,
{r('mx')} AS rolling_max_7,
{r('coalesce(last_value(CASE WHEN n >= 3 THEN sk END IGNORE NULLS) OVER (PARTITION BY f.key ORDER BY ds DESC), 0)')} AS rolling_skew_7
FROM f JOIN g ON g.key = f.key""")
def rolling_filled(spark, d):
    """Warm-up gaps of the rolling columns take the next value, then the key's statistic."""
    s = features.add_rolling(supp_daily(spark, d), (7,), ("mean", "std", "max", "skew"))
    return s.df.drop("y", "volume")


CALENDAR = """
CASE isodow(ds) WHEN 7 THEN 6 ELSE isodow(ds) - 1 END"""
CAL_SQL = f"""WITH {SEG}, c AS (SELECT key, ds, (isodow(ds) - 1)::INTEGER AS dow, month(ds)::INTEGER AS mo FROM seg)
SELECT key, {ts('ds')} AS ds, dow AS day_of_week, day(ds)::INTEGER AS day_of_month, mo AS month,
quarter(ds)::INTEGER AS quarter, year(ds)::INTEGER AS year, week(ds)::INTEGER AS week_of_year,
{r('sin(2 * pi() * dow / 7)')} AS day_of_week_sin, {r('cos(2 * pi() * dow / 7)')} AS day_of_week_cos,
{r('sin(2 * pi() * mo / 12)')} AS month_sin, {r('cos(2 * pi() * mo / 12)')} AS month_cos,
(dow >= 5)::INTEGER AS is_weekend,
(day(ds) = 1)::INTEGER AS is_month_start, (ds::DATE = last_day(ds::DATE))::INTEGER AS is_month_end,
(day(ds) = 1 AND mo IN (1, 4, 7, 10))::INTEGER AS is_quarter_start,
(ds::DATE = last_day(ds::DATE) AND mo IN (3, 6, 9, 12))::INTEGER AS is_quarter_end,
(day(ds) = 1 AND mo = 1)::INTEGER AS is_year_start,
(ds::DATE = last_day(ds::DATE) AND mo = 12)::INTEGER AS is_year_end,
CASE WHEN {{holiday}} THEN 1 ELSE 0 END::INTEGER AS is_holiday FROM c"""
HOLIDAY_SQL = """(
 strftime(ds, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25')
 OR (strftime(ds, '%m-%d') = '06-19' AND year(ds) >= 2021)
 OR (isodow(ds) = 5 AND strftime(ds + INTERVAL 1 DAY, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25'))
 OR (isodow(ds) = 1 AND strftime(ds - INTERVAL 1 DAY, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25'))
 OR (isodow(ds) = 5 AND strftime(ds, '%m-%d') = '06-18' AND year(ds) >= 2021)
 OR (isodow(ds) = 1 AND strftime(ds, '%m-%d') = '06-20' AND year(ds) >= 2021)
 OR (isodow(ds) = 1 AND mo IN (1, 2) AND day(ds) BETWEEN 15 AND 21)
 OR (isodow(ds) = 1 AND mo = 5 AND day(ds) >= 25)
 OR (isodow(ds) = 1 AND mo = 9 AND day(ds) <= 7)
 OR (isodow(ds) = 1 AND mo = 10 AND day(ds) BETWEEN 8 AND 14)
 OR (isodow(ds) = 4 AND mo = 11 AND day(ds) BETWEEN 22 AND 28))"""


@query(CAL_SQL.format(holiday=HOLIDAY_SQL))
def calendar_features(spark, d):
    return cal.add_calendar(seg_daily(spark, d).df.drop("y", "volume"))


@query(f"""SELECT count(*) AS n_events, strftime(ts, '%Y-%m-%d') AS day FROM (
  SELECT ts, ts AS ds, month(ts) AS mo FROM events) WHERE {HOLIDAY_SQL} GROUP BY 2""")
def events_on_holidays(spark, d):
    ev = cal.add_holiday(table(spark, d, "events").select("ts"), "ts")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return ev.filter("is_holiday = 1").groupBy(day).agg(F.count(F.lit(1)).alias("n_events"))


@query(f"""WITH {SEG} SELECT key, {ts('ds')} AS ds, {r('y')} AS y, {r('volume')} AS volume,
year(ds)::INTEGER AS year, month(ds)::INTEGER AS month, day(ds)::INTEGER AS day,
(isodow(ds) - 1)::INTEGER AS dayofweek, quarter(ds)::INTEGER AS quarter FROM seg""")
def regressor_features(spark, d):
    return features.regressor_features(seg_daily(spark, d))


@query(f"""WITH {SUPP}, m AS (SELECT key, avg(volume) AS mv, stddev_pop(volume) AS sv FROM supp GROUP BY 1)
SELECT s.key AS key, {ts('ds')} AS ds, {r('y')} AS y,
{r('(volume - mv) / CASE WHEN sv = 0 THEN 1 ELSE sv END')} AS volume FROM supp s JOIN m ON m.key = s.key""")
def standardize(spark, d):
    return features.standardize(supp_daily(spark, d)).df


@query(f"""WITH {SHIP}, m AS (SELECT key, avg(y) AS my, stddev_pop(y) AS sy FROM ship GROUP BY 1)
SELECT s.key AS key, l_orderkey, l_linenumber, {r('(y - my) / sy')} AS z
FROM ship s JOIN m ON m.key = s.key""")
def standardize_hot_keys(spark, d):
    """Scaling of raw rows: the statistics meet a hot key's rows by a salted join."""
    s = ship_rows(spark, d)
    out = features.standardize(s.on(s.df.withColumn("z", F.col("y"))), cols=["z"])
    return out.df.select("key", "l_orderkey", "l_linenumber", "z")


@query(f"""WITH {SUPP}, n AS (
  SELECT key, ds, row_number() OVER (PARTITION BY key ORDER BY ds) AS rn,
         count(*) OVER (PARTITION BY key) AS c FROM supp)
SELECT key, {ts('ds')} AS ds, rn <= floor(c * (1 - 0.2::DOUBLE)) AS is_train FROM n""")
def split_train_test(spark, d):
    return features.split_train_test(supp_daily(spark, d)).df.select("key", "ds", "is_train")


@query(f"""WITH {SHIP}, n AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn,
         count(*) OVER (PARTITION BY key) AS c FROM ship)
SELECT key, l_orderkey, l_linenumber, rn <= floor(c * (1 - 0.2::DOUBLE)) AS is_train FROM n""")
def split_hot_keys(spark, d):
    out = features.split_train_test(ship_rows(spark, d))
    return out.df.select("key", "l_orderkey", "l_linenumber", "is_train")


@query(f"""WITH {SUPP} SELECT key, 0.0::DOUBLE AS floor, {r('max(y) + 2 * stddev_samp(y)')} AS cap
FROM supp GROUP BY 1""")
def growth_bounds(spark, d):
    return features.growth_bounds(supp_daily(spark, d))


@query(f"""WITH {GAPPY} SELECT key, {ts('ds')} AS ds, {r('y')} AS y, {r('volume')} AS volume
FROM gappy WHERE y IS NOT NULL AND volume IS NOT NULL""")
def drop_missing(spark, d):
    return clean.drop_missing(supp_gappy(spark, d)).df


PREPARED = f"""WITH {SEG}, l AS (
  SELECT key, ds, y, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7, lag(y, 30) OVER w AS l30
  FROM seg WINDOW w AS (PARTITION BY key ORDER BY ds)),
f AS (
  SELECT *, avg(y) OVER (PARTITION BY key ORDER BY ds ROWS 6 PRECEDING) AS m7,
    row_number() OVER (PARTITION BY key ORDER BY ds) AS rn, count(*) OVER (PARTITION BY key) AS n
  FROM l WHERE l30 IS NOT NULL),
z AS (SELECT key, avg(l1) AS a1, stddev_pop(l1) AS s1, avg(l7) AS a7, stddev_pop(l7) AS s7,
      avg(m7) AS am, stddev_pop(m7) AS sm FROM f GROUP BY 1)
SELECT f.key AS key, {ts('ds')} AS ds, {r('y')} AS y, {r('(l1 - a1) / s1')} AS y_lag_1,
  {r('(l7 - a7) / s7')} AS y_lag_7, {r('(m7 - am) / sm')} AS rolling_mean_7,
  rn <= floor(n * (1 - 0.2::DOUBLE)) AS is_train
FROM f JOIN z ON z.key = f.key"""


@query(PREPARED)
def prepare_features(spark, d):
    """Lags, rolling, calendar, decorrelation, scaling and split as one lineage."""
    out, _ = features.prepare(seg_daily(spark, d))
    return out.df.select("key", "ds", "y", "y_lag_1", "y_lag_7", "rolling_mean_7", "is_train")


# --- indicators ------------------------------------------------------------------------------------

IND = f"""WITH {BARS}, w AS (
  SELECT key, ds, "Close" AS c, count(*) OVER u AS n,
    avg("Close") OVER b AS mid, stddev_pop("Close") OVER b AS sd,
    sum(("High" + "Low" + "Close") / 3 * "Volume") OVER v / sum("Volume") OVER v AS vw
  FROM bars WINDOW u AS (PARTITION BY key ORDER BY ds ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY key ORDER BY ds ROWS 19 PRECEDING), v AS (PARTITION BY key ORDER BY ds ROWS 13 PRECEDING))"""


@query(IND + f""" SELECT key, {ts('ds')} AS ds, CASE WHEN n >= 20 THEN {r('mid')} END AS "SMA",
CASE WHEN n >= 20 THEN {r('mid + 2 * sd')} END AS "BB_upper", CASE WHEN n >= 20 THEN {r('mid')} END AS "BB_middle",
CASE WHEN n >= 20 THEN {r('mid - 2 * sd')} END AS "BB_lower", CASE WHEN n >= 14 THEN {r('vw')} END AS "VWAP" FROM w""")
def window_indicators(spark, d):
    """SMA, Bollinger bands and VWAP without gap filling."""
    out = indicators.calculate_indicators(
        event_bars(spark, d), ("trend", "volatility", "volume"), fill_gaps=False
    )
    return out.df.select("key", "ds", "SMA", "BB_upper", "BB_middle", "BB_lower", "VWAP")


EMA_SQL = f"""WITH {BARS}, l AS (
  SELECT key, ds, row_number() OVER (PARTITION BY key ORDER BY ds) AS n,
    list("Close") OVER (PARTITION BY key ORDER BY ds ROWS BETWEEN 600 PRECEDING AND CURRENT ROW) AS xs FROM bars)
SELECT key, {ts('ds')} AS ds,
CASE WHEN n >= 20 THEN {r('list_reduce(xs, lambda e, x: (2.0::DOUBLE / 21) * x + (1 - 2.0::DOUBLE / 21) * e)')} END AS "EMA" FROM l"""


@query(EMA_SQL)
def ema(spark, d):
    out = indicators.ema_frame(event_bars(spark, d), "Close", {"EMA": 20})
    return out.df.select("key", "ds", "EMA")


# Value by value: the weight of the last mean has aged by the rows between.
EMA_GAPS = f"""WITH RECURSIVE {GAPPY}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds) AS row FROM gappy),
k AS (SELECT key, ds, y, row, row_number() OVER (PARTITION BY key ORDER BY ds) AS i,
  pow(1 - 2.0::DOUBLE / 21, row - lag(row) OVER (PARTITION BY key ORDER BY ds)) AS w FROM n WHERE y IS NOT NULL),
e AS (SELECT key, ds, i, y::DOUBLE AS e FROM k WHERE i = 1 UNION ALL
  SELECT k.key, k.ds, k.i, (k.w * e.e + k.y * 2 / 21) / (k.w + 2.0::DOUBLE / 21) FROM e JOIN k ON k.key = e.key AND k.i = e.i + 1)
SELECT n.key, {ts('n.ds')} AS ds, {r("CASE WHEN max(e.i) OVER w >= 20 THEN last_value(e.e IGNORE NULLS) OVER w END")} AS "EMA"
FROM n LEFT JOIN e ON e.key = n.key AND e.ds = n.ds WINDOW w AS (PARTITION BY n.key ORDER BY n.ds)"""


@query(EMA_GAPS)
def ema_over_gaps(spark, d):
    """Every day of a supplier's span: days without sales are NULL, keep the mean and age its weight."""
    out = indicators.ema_frame(supp_gappy(spark, d), "y", {"EMA": 20})
    return out.df.select("key", "ds", "EMA")


RSI_SQL = f"""WITH {BARS}, dl AS (
  SELECT key, ds, "Close" - lag("Close") OVER (PARTITION BY key ORDER BY ds) AS dx FROM bars),
l AS (
  SELECT key, ds, row_number() OVER w AS n,
    list(CASE WHEN dx > 0 THEN dx ELSE 0.0::DOUBLE END) OVER f AS us,
    list(CASE WHEN dx < 0 THEN -dx ELSE 0.0::DOUBLE END) OVER f AS ds_
  FROM dl WINDOW w AS (PARTITION BY key ORDER BY ds),
    f AS (PARTITION BY key ORDER BY ds ROWS BETWEEN 700 PRECEDING AND CURRENT ROW)),
e AS (SELECT key, ds, n,
  list_reduce(us, lambda e, x: x / 14 + (1 - 1.0::DOUBLE / 14) * e) AS up,
  list_reduce(ds_, lambda e, x: x / 14 + (1 - 1.0::DOUBLE / 14) * e) AS dn FROM l)
SELECT key, {ts('ds')} AS ds,
CASE WHEN n < 14 THEN NULL WHEN dn = 0 THEN 100 ELSE {r('100 - 100 / (1 + up / dn)')} END AS "RSI" FROM e"""


@query(RSI_SQL)
def rsi(spark, d):
    out = indicators.calculate_indicators(event_bars(spark, d), ("momentum",), fill_gaps=False)
    return out.df.select("key", "ds", "RSI")


@query(IND + f""", g AS (SELECT key, ds, CASE WHEN n >= 20 THEN mid END AS s FROM w)
SELECT key, {ts('ds')} AS ds, {r('coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds DESC), last_value(s IGNORE NULLS) OVER (PARTITION BY key ORDER BY ds))')} AS "SMA" FROM g""")
def indicators_filled(spark, d):
    """The default categories with backward, then forward filled gaps."""
    return indicators.calculate_indicators(event_bars(spark, d)).df.select("key", "ds", "SMA")


def _tail_list(n: int) -> str:
    """Weights of an exponential mean decay below 1e-20 within this many rows."""
    return f"ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


def _ema_of(lst: str, n: int) -> str:
    return f"list_reduce({lst}, lambda e, x: (2.0::DOUBLE / {n + 1}) * x + (1 - 2.0::DOUBLE / {n + 1}) * e)"


@query(f"""WITH {BARS}, l AS (
  SELECT key, ds, row_number() OVER (PARTITION BY key ORDER BY ds) AS n,
    list("Close") OVER (PARTITION BY key ORDER BY ds {_tail_list(700)}) AS xs FROM bars),
e AS (SELECT key, ds, n, CASE WHEN n >= 26 THEN {_ema_of('xs', 12)} - {_ema_of('xs', 26)} END AS m FROM l),
q AS (SELECT key, ds, m, count(m) OVER (PARTITION BY key ORDER BY ds) AS mc,
  list(m) FILTER (WHERE m IS NOT NULL) OVER (PARTITION BY key ORDER BY ds {_tail_list(300)}) AS ms FROM e)
SELECT key, {ts('ds')} AS ds, {r('m')} AS "MACD", CASE WHEN mc >= 9 THEN {r(_ema_of('ms', 9))} END AS "MACD_signal",
CASE WHEN mc >= 9 THEN {r('m - ' + _ema_of('ms', 9))} END AS "MACD_hist" FROM q""")
def macd(spark, d):
    out = indicators.macd(event_bars(spark, d))
    return out.df.select("key", "ds", "MACD", "MACD_signal", "MACD_hist")


@query(f"""WITH {BARS}, w AS (
  SELECT key, ds, "Close" AS c, count(*) OVER f AS n, min("Low") OVER f AS lo, max("High") OVER f AS hi
  FROM bars WINDOW f AS (PARTITION BY key ORDER BY ds ROWS 13 PRECEDING)),
k AS (SELECT key, ds, CASE WHEN n >= 14 AND hi > lo THEN 100 * (c - lo) / (hi - lo) END AS k FROM w),
e AS (SELECT key, ds, k, count(k) OVER f AS n, avg(k) OVER f AS a FROM k
  WINDOW f AS (PARTITION BY key ORDER BY ds ROWS 2 PRECEDING))
SELECT key, {ts('ds')} AS ds, {r('k')} AS stoch_k, CASE WHEN n >= 3 THEN {r('a')} END AS stoch_d FROM e""")
def stochastic(spark, d):
    return indicators.stochastic(event_bars(spark, d)).df.select("key", "ds", "stoch_k", "stoch_d")


@query(f"""WITH {BARS}, t AS (
  SELECT key, ds, "High" AS h, "Low" AS l, lag("Close") OVER (PARTITION BY key ORDER BY ds) AS p FROM bars),
x AS (SELECT key, ds, greatest(h - l, coalesce(abs(h - p), h - l), coalesce(abs(l - p), h - l)) AS tr FROM t),
g AS (SELECT key, ds, row_number() OVER (PARTITION BY key ORDER BY ds) AS n,
  list(tr) OVER (PARTITION BY key ORDER BY ds {_tail_list(700)}) AS xs FROM x)
SELECT key, {ts('ds')} AS ds, CASE WHEN n >= 14 THEN
{r('list_reduce(xs, lambda e, x: x / 14 + (1 - 1.0::DOUBLE / 14) * e)')} END AS "ATR" FROM g""")
def atr(spark, d):
    return indicators.atr(event_bars(spark, d)).df.select("key", "ds", "ATR")


@query(f"""WITH {SUPP}, w AS (
  SELECT key, ds, y, count(*) OVER f AS n, avg(y) OVER f AS m, stddev_samp(y) OVER f AS sd
  FROM supp WINDOW f AS (PARTITION BY key ORDER BY ds ROWS 19 PRECEDING))
SELECT key, {ts('ds')} AS ds, CASE WHEN n >= 20 AND sd > 0 THEN {r('(y - m) / sd')} END AS rolling_z FROM w""")
def rolling_zscore(spark, d):
    return indicators.rolling_zscore(supp_daily(spark, d)).df.select("key", "ds", "rolling_z")


@query(f"""WITH {SUPP}, x AS (SELECT key, ds, y - lag(y) OVER (PARTITION BY key ORDER BY ds) AS dx FROM supp),
w AS (SELECT key, ds, count(*) OVER f AS n, avg(CASE WHEN dx > 0 THEN dx ELSE 0 END) OVER f AS u,
  avg(CASE WHEN dx < 0 THEN -dx ELSE 0 END) OVER f AS v
  FROM x WINDOW f AS (PARTITION BY key ORDER BY ds ROWS 13 PRECEDING))
SELECT key, {ts('ds')} AS ds, CASE WHEN n < 14 OR (u = 0 AND v = 0) THEN NULL WHEN v = 0 THEN 100
  ELSE {r('100 - 100 / (1 + u / v)')} END AS "RSI_14" FROM w""")
def simple_rsi(spark, d):
    return indicators.simple_rsi(supp_daily(spark, d)).df.select("key", "ds", "RSI_14")


@query(f"""WITH {SHIP} SELECT key, l_orderkey, l_linenumber,
CASE WHEN count(*) OVER f >= 20 THEN {r('avg(y) OVER f', 3)} END AS sma
FROM ship WINDOW f AS (PARTITION BY key ORDER BY ds, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS 19 PRECEDING)""", digits=3)
def sma_hot_keys(spark, d):
    """A registered user indicator over raw rows of hot keys."""
    indicators.register_indicator("sma", lambda w: indicators.sma(w, F.col("y"), 20), lookback=20)
    out = indicators.custom_indicators(ship_rows(spark, d), ["sma"])
    return out.df.select("key", "l_orderkey", "l_linenumber", "sma")


@query(f"""WITH {SUPP} SELECT key, {ts('ds')} AS ds,
{r('max(y) OVER f - min(y) OVER f')} AS spread_5
FROM supp WINDOW f AS (PARTITION BY key ORDER BY ds ROWS 4 PRECEDING)""")
def custom_pandas_indicator(spark, d):
    """A registered pandas indicator, run per key (per segment for long keys)."""

    def spread(rows):
        w = rows["y"].rolling(5, min_periods=1)
        return w.max() - w.min()

    indicators.register_pandas_indicator("spread_5", spread, lookback=5)
    out = indicators.custom_indicators(supp_daily(spark, d), ["spread_5"])
    return out.df.select("key", "ds", "spread_5")


OVERLAY = IND + f""", o AS (SELECT key, ds, 'Close' AS indicator, c AS value FROM w UNION ALL
SELECT key, ds, 'SMA', CASE WHEN n >= 20 THEN mid END FROM w) SELECT key, {ts('ds')} AS ds, indicator, {r('value')} AS value FROM o"""


@query(OVERLAY)
def indicator_overlay(spark, d):
    out = indicators.calculate_indicators(event_bars(spark, d), ("trend",), fill_gaps=False)
    out = out.on(out.df.drop("EMA"))
    return indicators.overlay_table(out).drop("rsi_zone")


@query(RSI_SQL.replace('SELECT key, strftime', 'SELECT key AS k, strftime').join(["SELECT * FROM (SELECT key, rsi_zone, count(*) AS n FROM (SELECT k AS key, CASE WHEN \"RSI\" > 70 THEN 'overbought' WHEN \"RSI\" < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_zone FROM (", ")) GROUP BY 1, 2)"]))
def rsi_zones(spark, d):
    out = indicators.calculate_indicators(event_bars(spark, d), ("momentum",), fill_gaps=False)
    long = indicators.overlay_table(out).filter("indicator = 'RSI'")
    return long.groupBy("key", "rsi_zone").agg(F.count(F.lit(1)).alias("n"))

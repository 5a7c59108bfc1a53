"""Queries over data quality, cleaning, outliers and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.datasets import (
    EVENT, GAPPY, REV, SEG, SHIP, SUPP, event_bars, event_rows, rev_daily, seg_daily, ship_rows,
    supp_daily, supp_gappy, table,
)
from catalog.registry import query, r, ts
from tidemark.operators import charts, clean, profile
from tidemark.operators.quantiles import quantiles

NULLS = f"""WITH {GAPPY}, n AS (
  SELECT key, count(*) AS n, count(*) - count(ds) AS a, count(*) - count(y) AS b,
         count(*) - count(volume) AS c FROM gappy GROUP BY 1),
u AS (SELECT key, n, 'ds' AS col, a AS nulls FROM n UNION ALL SELECT key, n, 'y', b FROM n
      UNION ALL SELECT key, n, 'volume', c FROM n)
SELECT key, col AS "column", nulls, {r('nulls / n')} AS null_share, nulls / n > 0.2 AS is_issue FROM u"""


@query(NULLS)
def null_profile(spark, d):
    return profile.null_profile(supp_gappy(spark, d).df, ["key"])


def _value_sql(cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c}::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 2" for c in cols
    )
    return f"""WITH c AS ({parts}), a AS (
  SELECT col, sum(n)::BIGINT AS n_rows, count(v) AS n_unique, max(n) FILTER (WHERE v IS NOT NULL) AS top,
         sum(n) FILTER (WHERE v IS NOT NULL) AS known FROM c GROUP BY 1)
SELECT col AS "column", n_rows, n_unique, {r('n_unique / n_rows')} AS unique_ratio,
  n_unique / n_rows < 0.01 AS low_variance, {r('top / known')} AS top_share,
  top / known > 0.95 AS near_constant FROM a"""


@query(_value_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]))
def value_profile(spark, d):
    """Distinct ratio and most frequent value per column, over the whole table."""
    cols = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    return profile.value_profile(table(spark, d, "lineitem"), cols)


@query("""SELECT event_type AS key, 'value' AS "column", count(*) FILTER (WHERE event_id % 97 = 0) AS infinities
FROM events GROUP BY 1""")
def infinity_profile(spark, d):
    """Infinite ratios, made by a zero denominator on every 97th event."""
    zero = F.pmod("event_id", F.lit(97)) == 0
    bad = F.when(zero, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), bad.alias("value"))
    return profile.infinity_profile(rows, ["key"])


@query(f"""WITH {EVENT}, m AS (SELECT key, avg(y) AS a FROM ev GROUP BY 1), c AS (
  SELECT ev.key AS key, avg(pow(y - a, 2)) AS m2, avg(pow(y - a, 3)) AS m3, avg(pow(y - a, 4)) AS m4
  FROM ev JOIN m ON m.key = ev.key GROUP BY 1)
SELECT key, {r('m3 / pow(m2, 1.5)')} AS skew, {r('m4 / (m2 * m2) - 3')} AS kurt,
abs(m3 / pow(m2, 1.5)) > 3 AS highly_skewed, abs(m4 / (m2 * m2) - 3) > 10 AS extreme_kurtosis FROM c""")
def target_shape(spark, d):
    return profile.target_shape(event_rows(spark, d).df)


VALID = """, g AS (SELECT *, epoch_us(ds) - epoch_us(lag(ds) OVER (PARTITION BY key ORDER BY {order})) AS gap FROM {t}),
a AS (SELECT key, count(*) AS n_rows, count(ds) - count(DISTINCT ds) AS n_duplicates,
  count(*) FILTER (WHERE y < {neg}) AS n_negative, count(*) FILTER (WHERE ds > TIMESTAMP '{as_of}') AS n_future,
  datediff('hour', min(ds), max(ds)) // 24 AS range_days_h, date_diff('day', min(ds)::DATE, max(ds)::DATE) AS rd,
  (epoch_us(max(ds)) - epoch_us(min(ds))) // 86400000000 AS range_days,
  quantile_cont(gap::DOUBLE, 0.5) AS median_gap, max(gap) AS max_gap FROM g GROUP BY 1)
SELECT a.key AS key, n_rows, n_duplicates, n_negative, n_future, range_days, {med} AS median_gap, max_gap,
  coalesce(max_gap > 5 * median_gap, false) AS large_gap, range_days < 7 AS short_range"""


@query(f"WITH {SUPP}" + VALID.format(order="ds", t="supp", neg="0", as_of="2001-06-01", med=r("median_gap", 2)) + " FROM a", digits=2)
def validate_series(spark, d):
    s = supp_daily(spark, d)
    return profile.validate_series(s, as_of=F.lit("2001-06-01").cast("timestamp"))


@query(f"WITH {EVENT}, late AS (SELECT key, count(*) FILTER (WHERE p > ds) AS n_disordered FROM (SELECT key, ds, lag(ds) OVER (PARTITION BY key ORDER BY event_id) AS p FROM ev) GROUP BY 1)"
       + VALID.format(order="ds, event_id", t="ev", neg="0", as_of="2024-01-20", med=r("median_gap", 2))
       + ", n_disordered FROM a JOIN late ON late.key = a.key", digits=2)
def validate_raw_events(spark, d):
    """Validation of raw events in segments, with the order of arrival by event id."""
    s = event_rows(spark, d)
    return profile.validate_series(s, as_of=F.lit("2024-01-20").cast("timestamp"), arrival="event_id")


@query(f"""WITH {GAPPY}, c AS (
  SELECT key, 'y' AS col, count(*) AS n, count(*) - count(y) AS nulls, count(DISTINCT y) AS u FROM gappy GROUP BY 1
  UNION ALL SELECT key, 'volume', count(*), count(*) - count(volume), count(DISTINCT volume) FROM gappy GROUP BY 1)
SELECT key, col AS "column", nulls, {r('nulls / n')} AS null_share, nulls / n > 0.1 AS too_many_nulls, n AS n_rows,
{r('u / n')} AS unique_ratio, u / n < 0.01 AS low_variance, n < 100 AS too_few_rows FROM c""")
def validate_model_frame(spark, d):
    return profile.validate_model_frame(supp_gappy(spark, d))


@query("""SELECT event_type AS key, count(DISTINCT date_trunc('hour', ts)) AS n_rows, 0::BIGINT AS n_duplicates,
0.0::DOUBLE AS null_share_open, 0.0::DOUBLE AS null_share_high, 0.0::DOUBLE AS null_share_low,
0.0::DOUBLE AS null_share_close, 0.0::DOUBLE AS null_share_volume,
count(DISTINCT date_trunc('hour', ts)) < 100 AS too_few, false AS too_many_nulls FROM events GROUP BY 1""")
def validate_bars(spark, d):
    return profile.validate_bars(event_bars(spark, d))


@query(f"""WITH {GAPPY}, f AS (SELECT key, y, volume, volume * 0 AS zero FROM gappy)
SELECT 'y' AS feature, {r('avg((y IS NULL)::INT)')} AS null_share, 0::BIGINT AS infinities, min(y) = max(y) AS is_constant FROM f
UNION ALL SELECT 'volume', {r('avg((volume IS NULL)::INT)')}, 0, min(volume) = max(volume) FROM f
UNION ALL SELECT 'zero', {r('avg((zero IS NULL)::INT)')}, 0, min(zero) = max(zero) FROM f""")
def feature_quality(spark, d):
    df = supp_gappy(spark, d).df.withColumn("zero", F.col("volume") * 0)
    return profile.feature_quality(df, ["y", "volume", "zero"])


@query(f"""WITH f AS (SELECT l_returnflag AS key, l_quantity AS a, l_extendedprice AS b, l_discount AS c, 1 AS d FROM lineitem)
SELECT key, 'qty' AS col_a, 'price' AS col_b, {r('corr(a, b)')} AS r FROM f GROUP BY 1
UNION ALL SELECT key, 'qty', 'disc', {r('corr(a, c)')} FROM f GROUP BY 1
UNION ALL SELECT key, 'price', 'disc', {r('corr(b, c)')} FROM f GROUP BY 1
UNION ALL SELECT DISTINCT key, 'qty', 'one', NULL::DOUBLE FROM f
UNION ALL SELECT DISTINCT key, 'price', 'one', NULL::DOUBLE FROM f
UNION ALL SELECT DISTINCT key, 'disc', 'one', NULL::DOUBLE FROM f""")
def correlation_pairs(spark, d):
    """All pairs in one aggregation; a constant column correlates with nothing."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
        F.lit(1.0).alias("one"),
    )
    return profile.correlation_pairs(rows, ["qty", "price", "disc", "one"], ["key"])


@query(f"""WITH {REV} SELECT key, {ts('ds')} AS ds, {r('y')} AS y, {r('volume')} AS volume FROM rev""")
def decorrelate(spark, d):
    """A doubled and an opposite copy of volume are dropped, the first one stays."""
    s = rev_daily(spark, d)
    s = s.on(s.df.withColumns({"double_volume": F.col("volume") * 2, "opposite": 5 - F.col("volume")}))
    out, _ = profile.decorrelate(s, threshold=0.95)
    return out.df


@query(f"WITH {SUPP} SELECT key, {r('avg(y)')} AS mean, count(y) AS n, {r('quantile_cont(y, 0.5)')} AS median FROM supp GROUP BY 1")
def summary_stats(spark, d):
    return profile.summary_stats(supp_daily(spark, d))


QUANT = f"""SELECT key, {r('quantile_cont(y, 0.25)')} AS q25, {r('quantile_cont(y, 0.75)')} AS q75,
{r('quantile_cont(y, 0.01)')} AS q01, {r('quantile_cont(y, 0.99)')} AS q99"""
PROBS = {"q25": ("y", 0.25), "q75": ("y", 0.75), "q01": ("y", 0.01), "q99": ("y", 0.99)}


@query(f"WITH {SUPP} {QUANT} FROM supp GROUP BY 1")
def quantiles_daily(spark, d):
    return quantiles(supp_daily(spark, d), PROBS)


@query(f"WITH {SHIP} {QUANT} FROM ship GROUP BY 1")
def quantiles_hot_keys(spark, d):
    """Exact quantiles of raw rows: ranks of distinct values over segments."""
    return quantiles(ship_rows(spark, d), PROBS)


@query(f"""WITH {GAPPY}, m AS (SELECT key, avg(y) AS my, quantile_cont(volume, 0.5) AS mv FROM gappy GROUP BY 1)
SELECT g.key AS key, {ts('ds')} AS ds, {r('coalesce(y, my)')} AS y, {r('coalesce(volume, mv)')} AS volume
FROM gappy g JOIN m ON m.key = g.key""")
def impute_mean_median(spark, d):
    return clean.impute(supp_gappy(spark, d)).df


@query(f"""WITH {GAPPY}, m AS (
  SELECT key, 'y' AS c, 'mean' AS method, count(*) - count(y) AS filled, avg(y) AS v FROM gappy GROUP BY 1
  UNION ALL SELECT key, 'volume', 'median', count(*) - count(volume), quantile_cont(volume, 0.5) FROM gappy GROUP BY 1)
SELECT key, c AS "column", method, filled, {r('v')} AS fill_value FROM m WHERE filled > 0""")
def impute_stats(spark, d):
    return clean.impute_stats(supp_gappy(spark, d))


@query(f"""WITH {GAPPY}, c AS (
  SELECT key, 'y' AS col, count(*) - count(y) AS n FROM gappy GROUP BY 1
  UNION ALL SELECT key, 'volume', count(*) - count(volume) FROM gappy GROUP BY 1)
SELECT key, col AS "column", n AS missing_before, 0::BIGINT AS missing_after, n AS filled FROM c""")
def fill_stats(spark, d):
    """Spans start and end with a sale, so the forward fill leaves nothing open."""
    s = supp_gappy(spark, d)
    return clean.fill_stats(s, clean.forward_fill(s))


# --- outliers ---------------------------------------------------------------------------------------

ZS = "s.key AS key, " + ts("ds") + f" AS ds, {r('y')} AS y"
ZCTE = f"""WITH {SUPP}, m AS (SELECT key, avg(y) AS my, stddev_pop(y) AS sy, quantile_cont(y, 0.25) AS q1,
  quantile_cont(y, 0.75) AS q3, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM supp GROUP BY 1)"""
FZ = "coalesce(abs(y - my) / nullif(sy, 0) > 3, false)"
FI = "(y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))"


@query(f"{ZCTE} SELECT {ZS}, {FZ} AS is_outlier FROM supp s JOIN m ON m.key = s.key")
def zscore_outliers(spark, d):
    return clean.zscore_outliers(supp_daily(spark, d)).df.select("key", "ds", "y", "is_outlier")


@query(f"{ZCTE} SELECT {ZS}, {FI} AS is_outlier FROM supp s JOIN m ON m.key = s.key")
def iqr_outliers(spark, d):
    return clean.iqr_outliers(supp_daily(spark, d)).df.select("key", "ds", "y", "is_outlier")


@query(f"{ZCTE} SELECT {ZS.replace(r('y'), r(f'CASE WHEN {FZ} THEN greatest(least(y, hi), lo) ELSE y END'))} FROM supp s JOIN m ON m.key = s.key")
def clip_outliers(spark, d):
    return clean.clip_outliers(clean.zscore_outliers(supp_daily(spark, d))).df.select("key", "ds", "y")


@query(f"{ZCTE} SELECT {ZS} FROM supp s JOIN m ON m.key = s.key WHERE NOT {FI}")
def remove_outliers(spark, d):
    """Also the strict filter variant: rows within the quartile bounds stay."""
    return clean.remove_outliers(clean.iqr_outliers(supp_daily(spark, d))).df.select("key", "ds", "y")


@query(f"""WITH {SUPP}, n AS (SELECT key, ds, y, row_number() OVER (PARTITION BY key ORDER BY y) AS rn,
  count(*) OVER (PARTITION BY key) AS c FROM supp),
b AS (SELECT key, min(y) FILTER (WHERE rn > floor(c * 0.01::DOUBLE)) AS lo,
  max(y) FILTER (WHERE rn <= c - floor(c * 0.01::DOUBLE)) AS hi FROM n GROUP BY 1)
SELECT n.key AS key, {ts('ds')} AS ds, {r('greatest(least(y, hi), lo)')} AS y FROM n JOIN b ON b.key = n.key""")
def winsorize(spark, d):
    return clean.winsorize(supp_daily(spark, d)).df.select("key", "ds", "y")


@query(f"""{ZCTE} SELECT s.key AS key, count(*) FILTER (WHERE {FI}) AS n_outliers,
{r(f'min(y) FILTER (WHERE {FI})')} AS min_outlier, {r(f'max(y) FILTER (WHERE {FI})')} AS max_outlier,
{r(f'avg(y) FILTER (WHERE {FI})')} AS mean_outlier FROM supp s JOIN m ON m.key = s.key GROUP BY 1""")
def outlier_stats(spark, d):
    return clean.outlier_stats(clean.iqr_outliers(supp_daily(spark, d)))


@query(f"""WITH {SHIP}, m AS (SELECT key, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3,
  avg(y) AS my, stddev_pop(y) AS sy FROM ship GROUP BY 1)
SELECT s.key AS key, count(*) FILTER (WHERE y > q3 + 0.1 * (q3 - q1) OR y < q1 - 0.1 * (q3 - q1)) AS n_iqr,
count(*) FILTER (WHERE abs(y - my) / sy > 1.6) AS n_z FROM ship s JOIN m ON m.key = s.key GROUP BY 1""")
def outliers_hot_keys(spark, d):
    """Both detectors over raw rows of hot keys."""
    s = ship_rows(spark, d)
    a = clean.iqr_outliers(s, 0.1).df.groupBy("key").agg(F.count_if("is_outlier").alias("n_iqr"))
    b = clean.zscore_outliers(s, 1.6).df.groupBy("key").agg(F.count_if("is_outlier").alias("n_z"))
    return a.join(b, "key")


ENVELOPE = f"""WITH {SEG}, o AS (SELECT key, ds, y, row_number() OVER w AS rn, count(*) OVER (PARTITION BY key) AS n
  FROM seg WINDOW w AS (PARTITION BY key ORDER BY y)),
h AS (SELECT a.key, b.y - a.y AS len, (a.y + b.y) / 2 AS mid FROM o a JOIN o b
  ON a.key = b.key AND b.rn = a.rn + ceil((a.n + 2) / 2.0)::BIGINT),
best AS (SELECT key, min(len) AS len FROM h GROUP BY 1),
c AS (SELECT h.key AS key, avg(mid) AS loc FROM h JOIN best ON best.key = h.key AND h.len = best.len GROUP BY 1),
dv AS (SELECT o.*, abs(o.y - loc) AS dev, row_number() OVER (PARTITION BY o.key ORDER BY abs(o.y - loc)) AS dr
  FROM o JOIN c ON c.key = o.key),
v AS (SELECT key, var_pop(y) FILTER (WHERE dr <= ceil((n + 2) / 2.0)) AS v1 FROM dv GROUP BY 1),
s2 AS (SELECT dv.key, ds, y, dev * dev / v1 AS d2 FROM dv JOIN v ON v.key = dv.key),
m AS (SELECT key, quantile_cont(d2, 0.5) AS med FROM s2 GROUP BY 1),
rw AS (SELECT s2.key AS key, avg(y) AS loc2, var_pop(y) AS v2 FROM s2 JOIN m ON m.key = s2.key
  WHERE d2 / (med / 0.454936423119572) < 5.023886187314888 GROUP BY 1),
f AS (SELECT s2.key AS key, ds, y, pow(y - loc2, 2) / v2 AS dist FROM s2 JOIN rw ON rw.key = s2.key),
q AS (SELECT key, quantile_cont(dist, 0.9) AS cut FROM f GROUP BY 1)
SELECT f.key AS key, {ts('ds')} AS ds, {r('y')} AS y, dist > cut AS is_outlier FROM f JOIN q ON q.key = f.key"""


@query(ENVELOPE)
def envelope_outliers(spark, d):
    return clean.envelope_outliers(seg_daily(spark, d)).df.select("key", "ds", "y", "is_outlier")


@query()
def isolation_forest_outliers(spark, d):
    """Flags and scores depend on the seeded trees; tests check the properties."""
    return clean.forest_outliers(seg_daily(spark, d)).df.select("key", "ds", "y", "is_outlier")


@query(f"""WITH {GAPPY}, m AS (SELECT key, avg(y) AS my FROM gappy GROUP BY 1),
i AS (SELECT g.key AS key, ds, coalesce(y, my) AS y FROM gappy g JOIN m ON m.key = g.key),
z AS (SELECT key, avg(y) AS a, stddev_pop(y) AS s, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM i GROUP BY 1)
SELECT i.key AS key, {ts('ds')} AS ds,
{r('CASE WHEN abs(y - a) / s > 3 THEN greatest(least(y, hi), lo) ELSE y END')} AS y FROM i JOIN z ON z.key = i.key""")
def clean_default(spark, d):
    """Imputation, then clipped z-score outliers: the default cleaning."""
    return clean.clean(supp_gappy(spark, d)).df.select("key", "ds", "y")


# --- chart tables ------------------------------------------------------------------------------------


@query(f"""WITH {EVENT}, b AS (SELECT key, min(y) AS lo, max(y) AS hi FROM ev GROUP BY 1),
p AS (SELECT ev.key AS key, lo, (hi - lo) / 30 AS w, least(floor((y - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin
  FROM ev JOIN b ON b.key = ev.key)
SELECT key, bin, count(*) AS n, {r('min(lo + bin * w)')} AS "left", {r('min(lo + (bin + 1) * w)')} AS "right" FROM p GROUP BY 1, 2""")
def histogram(spark, d):
    return charts.histogram(event_rows(spark, d))


BOX = f"""q AS (SELECT key, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) AS q3 FROM ev GROUP BY 1),
f AS (SELECT ev.*, q1, med, q3, y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM ev JOIN q ON q.key = ev.key)"""


@query(f"""WITH {EVENT}, {BOX} SELECT key, {r('min(q1)')} AS q1, {r('min(med)')} AS median, {r('min(q3)')} AS q3,
{r('min(y) FILTER (WHERE inside)')} AS whisker_low, {r('max(y) FILTER (WHERE inside)')} AS whisker_high,
count(*) FILTER (WHERE NOT inside) AS n_fliers FROM f GROUP BY 1""")
def box_stats(spark, d):
    return charts.box_stats(event_rows(spark, d))


@query(f"""WITH {EVENT}, {BOX} SELECT key, {ts('ds')} AS ds, event_id, {r('y')} AS y FROM f WHERE NOT inside""")
def box_fliers(spark, d):
    return charts.fliers(event_rows(spark, d))


@query(f"""WITH {SEG}, v AS (SELECT key, y, count(*) AS c FROM seg GROUP BY 1, 2),
x AS (SELECT key, y, c, sum(c) OVER (PARTITION BY key ORDER BY y) AS hi, sum(c) OVER (PARTITION BY key) AS n FROM v)
SELECT key, {r('y')} AS value, c AS n_tied, {r('(hi - c + hi + 1) / 2')} AS rank FROM x""")
def qq_ranks(spark, d):
    """Ordered values and ranks of the Q-Q plot."""
    return charts.qq_points(seg_daily(spark, d)).drop("theoretical")


@query()
def qq_points(spark, d):
    """The normal quantiles have no DuckDB function; a test checks them."""
    return charts.qq_points(seg_daily(spark, d))

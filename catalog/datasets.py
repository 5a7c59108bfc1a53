"""Series that the registered queries build from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.series import Series, normalise, series
from tidemark.sources.bars import daily, make_bars, time_span


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As stored: builders that filter by time do so before any cast, so the scan can prune."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalise(raw(spark, sf_dir, name))


def seg_daily(spark: SparkSession, d: str) -> Series:
    """Order value per market segment and day."""
    orders = raw(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cust = raw(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    # The span of all orders, so that the look at it needs no join.
    return daily(
        joined, F.col("c_mktsegment"), "o_orderdate", F.sum("o_totalprice"),
        *time_span(orders, "o_orderdate"), volume=F.count(F.lit(1)).cast("double"),
    )


def rev_daily(spark: SparkSession, d: str) -> Series:
    """Revenue per return flag and day of shipping."""
    return _shipped(spark, d, "l_returnflag")


def supp_daily(spark: SparkSession, d: str) -> Series:
    """Revenue per supplier and day of shipping: the many-series case."""
    return _shipped(spark, d, "l_suppkey")


def _shipped(spark: SparkSession, d: str, key: str) -> Series:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return daily(
        raw(spark, d, "lineitem"), F.col(key), "l_shipdate", F.sum(revenue),
        volume=F.sum("l_quantity"),
    )


def event_bars(spark: SparkSession, d: str, interval: str = "1h") -> Series:
    return make_bars(
        raw(spark, d, "events"), interval=interval, key="event_type", ts="ts", price="value", volume=F.lit(1.0), tie=["event_id"],
    )


def supp_gappy(spark: SparkSession, d: str) -> Series:
    """``supp_daily`` on every day of each supplier's span: days without sales are NULL."""
    s = supp_daily(spark, d)
    # Each day brings the empty ones up to the next: only the narrow days with sales move, and rows stay with their key.
    after = F.lead("ds").over(Window.partitionBy("key").orderBy("ds"))
    days = s.df.where("ds IS NOT NULL").withColumn("_after", after)
    until = F.coalesce(F.col("_after") - F.expr("INTERVAL 1 DAY"), F.col("ds"))
    days = days.withColumn("_day", F.explode(F.sequence("ds", until, F.expr("INTERVAL 1 DAY"))))
    sold = (F.col("_day") == F.col("ds")) & F.col("key").isNotNull()
    return s.on(days.select("key", F.col("_day").alias("ds"), *[F.when(sold, F.col(c)).alias(c) for c in ("y", "volume")]))


# Segments this short split the hot keys even at the check's scale.
RAW_SEGMENT_ROWS = 8_000


def ship_rows(spark: SparkSession, d: str) -> Series:
    """Raw line items per return flag, in shipping order: three hot keys and no row bound."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("key"), F.col("l_shipdate").alias("ds"),
        F.col("l_extendedprice").alias("y"), "l_orderkey", "l_linenumber",
        "l_partkey", "l_suppkey",
    )
    return series(rows, seq=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], segment_rows=RAW_SEGMENT_ROWS)


def event_rows(spark: SparkSession, d: str) -> Series:
    """Raw events per type in arrival order."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("key"), F.col("ts").alias("ds"), F.col("value").alias("y"),
        "event_id", "user_id",
    )
    return series(rows, seq=["event_id"], segment_rows=1_000)


# --- the same series as SQL -----------------------------------------------------------------

SEG = """seg AS (
  SELECT c_mktsegment AS key, date_trunc('day', o_orderdate)::TIMESTAMP AS ds,
         sum(o_totalprice) AS y, count(*)::DOUBLE AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
REV = """rev AS (
  SELECT l_returnflag AS key, date_trunc('day', l_shipdate)::TIMESTAMP AS ds,
         sum(l_extendedprice * (1 - l_discount)) AS y, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
SUPP = """supp AS (
  SELECT l_suppkey::VARCHAR AS key, date_trunc('day', l_shipdate)::TIMESTAMP AS ds,
         sum(l_extendedprice * (1 - l_discount)) AS y, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
GAPPY = SUPP + """, span AS (SELECT key, min(ds) AS lo, max(ds) AS hi FROM supp GROUP BY 1),
dense AS (SELECT key, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM span),
gappy AS (SELECT d.key, d.ds, s.y, s.volume
          FROM dense d LEFT JOIN supp s ON s.key = d.key AND s.ds = d.ds)"""
BARS = """bars AS (
  SELECT event_type AS key, date_trunc('hour', ts)::TIMESTAMP AS ds,
         arg_min(value, (ts, event_id)) AS "Open", max(value) AS "High",
         min(value) AS "Low", arg_max(value, (ts, event_id)) AS "Close",
         count(*)::DOUBLE AS "Volume"
  FROM events GROUP BY 1, 2)"""
SHIP = """ship AS (
  SELECT l_returnflag AS key, l_shipdate AS ds, l_extendedprice AS y, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""
EVENT = """ev AS (
  SELECT event_type AS key, ts AS ds, value AS y, event_id, user_id FROM events)"""

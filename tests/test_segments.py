"""Segmented computation equals the plain window, with hot keys, gaps and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tidemark.operators import clean, features, indicators
from tidemark.operators.quantiles import quantiles
from tidemark.plans.segments import fill, numbered, planned, running, segment, windowed, with_stats
from tidemark.plans.series import series


@pytest.fixture(scope="module")
def frame(spark):
    """One hot key in bursts, one medium key, and small keys."""
    rng = np.random.default_rng(5)
    parts = []
    for key, n in (("hot", 900), ("mid", 150), ("a", 7), ("b", 1)):
        burst = np.sort(np.concatenate([rng.integers(0, 10**6, n // 2), rng.integers(4 * 10**5, 4 * 10**5 + 300, n - n // 2)]))
        y = np.round(rng.normal(50, 10, n), 3)
        y[rng.random(n) < 0.2] = np.nan
        parts.append(pd.DataFrame({"key": key, "sec": burst, "seq": np.arange(n), "y": y}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    df = df.withColumn("ds", F.timestamp_seconds("sec")).select("key", "ds", "seq", "y")
    return df.repartition(3).persist()


def both(df, rows=100):
    plain = series(df, seq=["seq"], max_rows=10_000)
    split = planned(series(df, seq=["seq"], segment_rows=rows))
    assert split.layout is not None and plain.bounded
    return plain, split


def same(a, b):
    order = ["key", "ds", "seq"]
    a, b = rows_of(a, *order), rows_of(b, *order)
    pd.testing.assert_frame_equal(a, b[a.columns.tolist()], check_exact=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("lookback", [0, 1, 6, 29, 250])
def test_every_home_row_once_with_its_lookback(frame, lookback):
    _, split = both(frame)
    seg = segment(split, lookback)
    assert seg.split
    got = seg.finish(seg.df)
    assert got.count() == frame.count()
    assert seg.df.filter("_home").groupBy("key", "_seg").count().agg(F.max("count")).first()[0] < 900


@pytest.mark.parametrize("n", [2, 7, 30, 150])
def test_windows(frame, n):
    plain, split = both(frame)

    def build(w):
        f = w.rowsBetween(1 - n, 0)
        return {"m": F.avg("y").over(f), "c": F.count("y").over(f), "l": F.lag("y", n - 1).over(w)}

    same(windowed(plain, n, build), windowed(split, n, build))


def test_tiny_segments_reach_several_back(frame):
    plain, split = both(frame, rows=20)
    build = lambda w: {"m": F.sum("y").over(w.rowsBetween(-70, 0))}
    same(windowed(plain, 71, build), windowed(split, 71, build))


def test_fills_sums_numbers(frame):
    plain, split = both(frame)
    for forward in (True, False):
        same(fill(plain, {"f": F.col("y")}, forward), fill(split, {"f": F.col("y")}, forward))
    args = dict(sums={"s": F.col("y")}, maxima={"m": F.col("y")})
    same(running(plain, **args), running(split, **args))
    same(numbered(plain), numbered(split))


def test_statistics_join_is_salted(frame):
    plain, split = both(frame)
    stats = {"a": F.avg("y"), "n": F.count("y")}
    same(with_stats(plain, stats), with_stats(split, stats))


def test_quantiles_with_ties(spark):
    values = [0.0] * 400 + list(np.round(np.random.default_rng(1).exponential(1, 300), 2))
    pdf = pd.DataFrame({"key": "k", "i": range(700), "y": values})
    df = spark.createDataFrame(pdf).withColumn("ds", F.timestamp_seconds("i")).select("key", "ds", "y")
    probs = {f"q{i}": ("y", q) for i, q in enumerate((0.0, 0.01, 0.25, 0.5, 0.61, 0.75, 0.99, 1.0))}
    split = quantiles(series(df, segment_rows=60), probs).first()
    for i, q in enumerate((0.0, 0.01, 0.25, 0.5, 0.61, 0.75, 0.99, 1.0)):
        assert split[f"q{i}"] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_operators_agree(frame):
    plain, split = both(frame.filter("y IS NOT NULL"))
    same(indicators.ema_frame(plain, "y", {"e": 5}).df, indicators.ema_frame(split, "y", {"e": 5}).df)
    same(clean.winsorize(plain, 0.05, 0.05).df, clean.winsorize(split, 0.05, 0.05).df)
    same(clean.iqr_outliers(plain).df, clean.iqr_outliers(split).df)
    same(clean.envelope_outliers(plain).df, clean.envelope_outliers(split).df)
    same(features.split_train_test(plain).df, features.split_train_test(split).df)
    same(features.standardize(plain, ["y"]).df, features.standardize(split, ["y"]).df)


def test_interpolation_agrees(frame):
    plain, split = both(frame)
    same(clean.interpolate(plain, ["y"]).df, clean.interpolate(split, ["y"]).df)


def test_short_table_is_bounded_by_its_count(frame):
    s = planned(series(frame, seq=["seq"], segment_rows=5_000))
    assert s.bounded and s.max_rows == frame.count()


def test_without_long_keys_the_plain_way(spark):
    df = spark.range(1000).select(
        (F.col("id") % 100).cast("string").alias("key"), F.timestamp_seconds("id").alias("ds"), F.rand(1).alias("y")
    )
    assert planned(series(df, segment_rows=50)).bounded


@pytest.mark.parametrize("seq", ["number", "text", "two"])
def test_few_distinct_times_are_split_by_the_rest_of_the_order(spark, seq):
    """20 times, each held by a tenth of a key or more: no segment exceeds its rows."""
    n = 40_000
    cols = {
        "number": (F.col("id").alias("a"), F.lit(0).alias("b")),
        "text": (F.lpad(F.col("id").cast("string"), 5, "0").alias("a"), F.lit(0).alias("b")),
        "two": (F.floor(F.col("id") / 10_000).alias("a"), F.col("id").alias("b")),
    }[seq]
    time = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 7919) % 20)
    df = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, "cold").otherwise("hot").alias("key"), F.timestamp_seconds(time).alias("ds"), *cols,
        (F.col("id") % 101).cast("double").alias("y"),
    ).persist()
    s = planned(series(df, seq=["a", "b"], segment_rows=1000))
    seg = segment(s)
    sizes = seg.df.filter("_home").groupBy(*seg.part).count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (sizes.agg(F.max("count")).first()[0], n)
    assert sizes.agg(F.max("count")).first()[0] <= 1000
    plain = series(df, seq=["a", "b"], max_rows=n)
    order = ["key", "ds", "a", "b"]
    build = lambda w: {"m": F.sum("y").over(w.rowsBetween(-30, 0)), "l": F.lag("y", 30).over(w)}
    for mine, whole in ((windowed(s, 31, build), windowed(plain, 31, build)), (numbered(s), numbered(plain))):
        mine, whole = rows_of(mine, *order), rows_of(whole, *order)
        pd.testing.assert_frame_equal(mine[whole.columns.tolist()], whole)


def test_times_that_are_null_come_first(spark):
    df = spark.range(3000).select(
        F.lit("k").alias("key"), F.when(F.col("id") % 3 > 0, F.timestamp_seconds("id")).alias("ds"), F.col("id").alias("seq"),
        F.col("id").cast("double").alias("y"),
    )
    s = planned(series(df, seq=["seq"], segment_rows=200))
    assert s.layout is not None
    a, b = rows_of(numbered(s), "seq"), rows_of(numbered(series(df, seq=["seq"], max_rows=3000)), "seq")
    assert (a["rn"] == b["rn"]).all()

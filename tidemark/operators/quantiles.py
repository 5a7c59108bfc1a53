"""Exact quantiles and order statistics that never gather a hot key in one task."""

from __future__ import annotations

from collections.abc import Mapping
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.segments import attach, running
from tidemark.plans.series import Series


def value_ranks(s: Series, col: str) -> DataFrame:
    """Distinct values per key with their 0-based rank interval ``[lo, hi)`` and row count ``n``.

    Equal values collapse in a partial aggregation before anything is sorted, so a value shared
    by a third of the rows costs one row here.
    """
    keys = list(s.keys)
    distinct = (
        s.df.filter(F.col(col).isNotNull())
        .groupBy(*keys, F.col(col).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    ds = s.reordered(distinct, "v", max_rows=s.max_rows)
    cum = running(ds, sums={"hi": F.col("cnt")})
    cum = cum.withColumn("lo", F.col("hi") - F.col("cnt"))
    if s.bounded:
        return cum.withColumn("n", F.sum("cnt").over(Window.partitionBy(*keys)))
    totals = distinct.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    return attach(ds.on(cum), totals)


def quantiles(s: Series, probs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row per key: linearly interpolated exact quantiles, ``name -> (column, q)``."""
    keys = list(s.keys)
    if s.bounded:
        return s.df.groupBy(*keys).agg(
            *[F.percentile(F.col(c).cast("double"), F.lit(q)).alias(n) for n, (c, q) in probs.items()]
        )
    out = None
    for col in dict.fromkeys(c for c, _ in probs.values()):
        ranks = value_ranks(s, col)
        wanted = {n: q for n, (c, q) in probs.items() if c == col}
        picks = []
        for name, q in wanted.items():
            at = (F.col("n") - 1) * F.lit(float(q))
            below = F.floor(at)
            above = F.least(below + 1, F.col("n") - 1)

            def holds(k):
                return (F.col("lo") <= k) & (k < F.col("hi"))

            picks += [
                F.max(F.when(holds(below), F.col("v"))).alias(f"{name}_a"),
                F.max(F.when(holds(above), F.col("v"))).alias(f"{name}_b"),
                F.max(at - below).alias(f"{name}_w"),
            ]
        one = ranks.groupBy(*keys).agg(*picks).select(
            *keys,
            *[
                (
                    F.col(f"{n}_a") + F.col(f"{n}_w") * (F.col(f"{n}_b") - F.col(f"{n}_a"))
                ).alias(n)
                for n in wanted
            ],
        )
        out = one if out is None else out.join(one, keys, "full")
    return out


def with_quantiles(s: Series, probs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Add exact per-key quantiles to every row."""
    if s.bounded:
        whole = Window.partitionBy(*s.keys)
        return s.df.withColumns(
            {
                n: F.percentile(F.col(c).cast("double"), F.lit(q)).over(whole)
                for n, (c, q) in probs.items()
            }
        )
    return attach(s, quantiles(s, probs))

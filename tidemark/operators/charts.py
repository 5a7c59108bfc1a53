"""The tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import normal_quantile
from tidemark.operators.quantiles import quantiles, value_ranks
from tidemark.plans.segments import attach, with_stats
from tidemark.plans.series import Series


def histogram(s: Series, bins: int = 30) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin holds the maximum."""
    df = with_stats(s, {"_lo": F.min(s.y), "_hi": F.max(s.y)}).filter(F.col(s.y).isNotNull())
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(s.y) - F.col("_lo"), width)), F.lit(0))
    df = df.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return df.groupBy(*s.keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("_lo") + F.col("bin") * width).alias("left"),
        F.min(F.col("_lo") + (F.col("bin") + 1) * width).alias("right"),
    )


def qq_points(s: Series) -> DataFrame:
    """Ordered values against normal quantiles at Filliben's plotting positions.

    Tied values come as one row with their rank range, at the mean rank.
    """
    ranks = value_ranks(s, s.y)
    n = F.col("n").cast("double")
    end = F.pow(F.lit(0.5), 1 / n)
    rank = (F.col("lo") + F.col("hi") + 1) / 2
    pos = (
        F.when((rank == 1) & (F.col("cnt") == 1), 1 - end)
        .when((rank == n) & (F.col("cnt") == 1), end)
        .otherwise((rank - 0.3175) / (n + 0.365))
    )
    return ranks.select(
        *s.keys, F.col("v").alias("value"), F.col("cnt").alias("n_tied"), rank.alias("rank"),
        normal_quantile(pos).alias("theoretical"),
    )


def box_stats(s: Series, whisker: float = 1.5) -> DataFrame:
    """Quartiles, the whisker ends (the farthest values within reach) and the fliers' count."""
    q = quantiles(s, {"q1": (s.y, 0.25), "median": (s.y, 0.5), "q3": (s.y, 0.75)})
    y = F.col(s.y)
    reach = (F.col("q3") - F.col("q1")) * whisker
    inside = F.when(y.between(F.col("q1") - reach, F.col("q3") + reach), y)
    return attach(s, q).groupBy(*s.keys).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        (F.count(y) - F.count(inside)).alias("n_fliers"),
    )


def fliers(s: Series, whisker: float = 1.5) -> DataFrame:
    q = quantiles(s, {"_q1": (s.y, 0.25), "_q3": (s.y, 0.75)})
    reach = (F.col("_q3") - F.col("_q1")) * whisker
    far = (F.col(s.y) < F.col("_q1") - reach) | (F.col(s.y) > F.col("_q3") + reach)
    return attach(s, q).filter(far).select(*s.keys, *s.order, s.y)


def forecast_components(
    forecast: DataFrame, components: Sequence[str] = ("yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "weekly"),
    keys: Sequence[str] = ("key",), ds: str = "ds",
) -> DataFrame:
    """Long component table; ``is_future`` splits fit and forecast when the column is there."""
    ids = [*keys, ds] + (["is_future"] if "is_future" in forecast.columns else [])
    cols = [c for c in components if c in forecast.columns]
    return forecast.select(*ids, *cols).unpivot(ids, cols, "component", "value")


def interval_polygon(forecast: DataFrame, keys: Sequence[str] = ("key",), ds: str = "ds") -> DataFrame:
    """Outline of the interval: upper bounds in time order, then lower bounds backwards.

    The ordinal is the signed time, so it needs no global numbering.
    """
    t = F.unix_micros(F.col(ds).cast("timestamp"))
    upper = forecast.select(*keys, ds, F.col("yhat_upper").alias("bound"), F.lit(0).alias("side"), t.alias("ordinal"))
    lower = forecast.select(*keys, ds, F.col("yhat_lower").alias("bound"), F.lit(1).alias("side"), (-t).alias("ordinal"))
    return upper.unionByName(lower)

"""Scalar column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: Column, high: Column) -> Column:
    """NULL stays NULL (greatest and least alone would return the bound)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """NULL at a zero denominator, which ANSI division would raise on."""
    return F.try_divide(a, b)


def percent_error(actual: Column, predicted: Column) -> Column:
    return F.try_divide(F.abs(actual - predicted), actual) * 100


def parse_date(text: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def format_date(ts: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(ts, fmt)


def duration(text: str) -> Column:
    """An interval literal from text such as '30 days'."""
    return F.expr(f"INTERVAL '{parse_duration(text)} seconds'")


def parse_duration(text: str) -> int:
    """Seconds in text such as '365 days' or '12 hours'."""
    import pandas as pd

    return int(pd.Timedelta(text).total_seconds())


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal distribution by a rational approximation (error < 1.2e-9).

    The coefficients are the published fixed values of the approximation.
    """
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)

    def poly(x: Column, coefs: tuple[float, ...]) -> Column:
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + k
        return out

    def tail(prob: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.log(prob))
        return poly(q, c) / (poly(q, d) * q + 1)

    r = (p - 0.5) * (p - 0.5)
    middle = poly(r, a) * (p - 0.5) / (poly(r, b) * r + 1)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < 0.02425, tail(p))
        .when(p > 1 - 0.02425, -tail(F.lit(1.0) - p))
        .otherwise(middle)
    )

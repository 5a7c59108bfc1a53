"""Name -> query and name -> SQL tables, filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 4):
    """Register a query under the function's name; doubles are rounded, times become text."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tidemark.session import configure

            return present(fn(configure(spark), sf_dir), digits)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return run

    return wrap


def present(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, dates and times as text, so that two engines can be compared."""
    return df.select(*[_shown(f, digits).alias(f.name) for f in df.schema.fields])


def _shown(f: T.StructField, digits: int) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        x, scale = c.cast("double") + F.lit(_nudge(digits)), F.lit(float(10**digits))
        # Away from ties and at sizes where the product is exact enough, the nearest whole number is what
        # F.round finds through a decimal, which costs several times as much.
        whole = F.floor(x * scale + 0.5)
        plain = (F.abs(x * scale) < 1e11) & (F.abs(F.abs(x * scale - whole) - 0.5) > 1e-3)
        # Adding zero turns a rounded -0.0 into 0.0.
        return F.when(plain, whole / scale).otherwise(F.round(x, digits)) + F.lit(0.0)
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(f.dataType, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c


def _nudge(digits: int) -> float:
    """Moves means of few decimals off the exact ties, on which engines round differently."""
    return float(f"3.1e-{digits + 3}")


def r(expr: str, digits: int = 4) -> str:
    """SQL text of a rounded double."""
    return f"(round(CAST({expr} AS DOUBLE) + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def ts(expr: str) -> str:
    """SQL text of a time as the queries show it."""
    return f"strftime(CAST({expr} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"

"""Values of other series on the rows of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.segments import fill
from tidemark.plans.series import Series, series


def as_of(s: Series, other: DataFrame, cols: Sequence[str], per_key: bool = False) -> DataFrame:
    """Each row gets the last values of ``other`` at or before its time.

    The rows of ``other`` are merged with the series' in time order and filled forward; they sort
    before series rows of the same time. Values that all keys share are looked up once per distinct
    time and joined to the rows of that time, so their number does not multiply with the keys.
    """
    if not per_key:
        return _shared_as_of(s, other, cols)
    keys = list(s.keys)
    mine = [c for c in s.df.columns if c not in cols]
    rows = s.df.select(*mine, F.lit(1).alias("_side"))
    marks = other.select(*keys, s.ds, *[F.col(c).alias(f"_v_{c}") for c in cols], F.lit(0).alias("_side"))
    merged = rows.unionByName(marks, allowMissingColumns=True)
    # The merged keys have no proven bound of their own; a count settles it.
    line = s.reordered(merged, s.ds, ("_side", *s.seq))
    out = fill(line, {c: F.col(f"_v_{c}") for c in cols}).filter("_side = 1")
    return out.select(*mine, *cols)


def _shared_as_of(s: Series, other: DataFrame, cols: Sequence[str]) -> DataFrame:
    mine = [c for c in s.df.columns if c not in cols]
    times = s.df.select(s.ds).distinct().withColumn("_side", F.lit(1))
    marks = other.select(s.ds, *[F.col(c).alias(f"_v_{c}") for c in cols], F.lit(0).alias("_side"))
    merged = times.unionByName(marks, allowMissingColumns=True).withColumn("_line", F.lit(0))
    line = series(merged, "_line", s.ds, "_side", ("_side",), segment_rows=s.segment_rows)
    known = fill(line, {c: F.col(f"_v_{c}") for c in cols}).filter("_side = 1").select(s.ds, *cols)
    # Rows without a time have no value, as NULL is before all times.
    return s.df.select(*mine).join(known, s.ds, "left").select(*mine, *cols)

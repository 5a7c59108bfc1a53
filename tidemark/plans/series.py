"""The long series frame every operator works on.

A series frame is an ordinary DataFrame with one or more key columns, a time column and a
target. ``max_rows`` is a *proven* upper bound on the rows of one key, for example the number
of daily slots between two dates once the frame has been aggregated to one row per key and
day. A proven bound lets an operator use a plain per-key window: one shuffle on the key. With
no bound (raw events, where one key may hold a third of all rows) the same operator splits
each long key into segments; see :mod:`tidemark.plans.segments`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows one task may sort for one key. A window sort spills, so this is about balance, not fit.
SEGMENT_ROWS = 1_000_000


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...] = ("key",)
    ds: str = "ds"
    y: str = "y"
    seq: tuple[str, ...] = ()
    max_rows: int | None = None
    segment_rows: int = SEGMENT_ROWS
    # How the order is cut into cells and the segments of long keys, once `planned` has looked at
    # an unbounded series.
    splits: tuple | None = None
    layout: DataFrame | None = None

    @property
    def order(self) -> list[str]:
        return [self.ds, *self.seq]

    @property
    def bounded(self) -> bool:
        return self.max_rows is not None and self.max_rows <= self.segment_rows

    def on(self, df: DataFrame) -> Series:
        """The same rows with other columns."""
        return replace(self, df=df)

    def filtered(self, df: DataFrame) -> Series:
        """Some of the rows: a bound still holds, the place of segments does not."""
        return replace(self, df=df, splits=None, layout=None)

    def reordered(
        self, df: DataFrame, ds: str, seq: Sequence[str] = (), max_rows: int | None = None
    ) -> Series:
        """A series over other rows or another order; nothing known of the old order holds."""
        return replace(
            self, df=df, ds=ds, seq=tuple(seq), max_rows=max_rows, splits=None, layout=None
        )

    def select(self, *cols: str | Column) -> DataFrame:
        return self.df.select(*cols)


def series(
    df: DataFrame,
    keys: str | Sequence[str] = "key",
    ds: str = "ds",
    y: str = "y",
    seq: Sequence[str] = (),
    max_rows: int | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> Series:
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    missing = [c for c in (*keys, ds, y, *seq) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return Series(df, keys, ds, y, tuple(seq), max_rows, segment_rows)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


# Integer calendar columns that never serve as regressors of the forecaster.
NON_REGRESSORS = ("ds", "y", "day_of_week", "day_of_month", "month", "quarter")


def regressor_columns(s: Series, all_numeric: bool = False) -> list[str]:
    """Numeric columns used as extra regressors; ``all_numeric`` keeps the calendar ones."""
    skip = (s.ds, s.y) if all_numeric else (*NON_REGRESSORS, s.ds, s.y)
    return numeric_columns(s.df, exclude=(*skip, *s.keys, *s.seq))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL and zone-less timestamps become UTC timestamps, once, at load."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        else:
            cols.append(c)
            continue
        cols.append(c.alias(f.name))
    return df.select(*cols)


def strip_tz(df: DataFrame, col: str, zone: str | None = None) -> DataFrame:
    """Drop the time zone and keep local wall-clock time (of ``zone``, else of the session)."""
    c = F.col(col)
    if zone is not None:
        c = F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))
    return df.withColumn(col, c.cast("timestamp_ntz"))


def slots(start: str, end: str, step_seconds: float) -> int:
    """Number of grid slots in [start, end): a bound on the rows of one key on that grid."""
    import pandas as pd

    span = (pd.Timestamp(end) - pd.Timestamp(start)).total_seconds()
    if span <= 0:
        raise ValueError("start must lie before end")
    return int(span // step_seconds) + 1


def whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows that stream past in order, as tables of whole keys of about ``most`` rows; ``_place`` numbers a key's rows from 1."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        # The last key may go on in the next batch; a key that fills all that is held has not ended.
        begins = np.flatnonzero(batch.column("_place").to_numpy() == 1)
        if len(begins) and (cut := rows - batch.num_rows + int(begins[-1])):
            found = pa.Table.from_batches(held)
            yield found.slice(0, cut)
            held, rows = found.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)

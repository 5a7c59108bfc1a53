"""Per-key ordered computation that survives a hot key.

A plain window ``partitionBy(key)`` sorts all rows of a key in one task. That is right for keys
with a proven bound and wrong for a key that holds a third of the table. For unbounded series
the rows of long keys are split into *segments* of about ``segment_rows`` consecutive rows:

1. The order is cut into cells of about equal frequency over the whole table: the first order column
   by a quantile sketch and, where one value of it holds too many rows of a key, by the next order
   column among the rows of that value, and so on. So only rows that tie in the whole order can
   make a (key, cell) group longer than a quarter of a segment.
2. One narrow partial aggregation counts rows per (key, cell). Running sums over that small
   table give the number of rows before each cell, hence the segment of each cell.
3. A finite frame that looks back ``lookback`` rows needs the rows just before its segment:
   whole cells that may hold them are copied into the next segment and dropped afterwards.
4. Running computations (fills, running sums, row numbers) run within segments, and one carry
   row per segment is combined along the key and joined back on (key, segment).

Short keys keep segment 0 and are not copied. All results equal the plain window's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tidemark.plans.series import Series
from tidemark.session import settled

CELL, SEG, HOME, BASE = "_cell", "_seg", "_home", "_base"
MAX_CELLS = 50_000
CELLS_PER_SEGMENT = 8  # a copied cell is about this fraction of a segment, twice that at most
SKETCH_ROWS = 2_000_000


@dataclass(frozen=True)
class Segments:
    """A frame ready for per-segment windows. ``part`` is what windows partition by."""

    s: Series
    df: DataFrame
    part: list[str]
    split: bool

    def window(self, descending: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if descending else F.col(c) for c in self.s.order]
        return Window.partitionBy(*self.part).orderBy(*order)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(HOME)).drop(CELL, SEG, HOME, BASE) if self.split else df


def _position(df: DataFrame, col: str) -> Column:
    """An order column as a double that never falls where the column rises; NULL comes first."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        place = F.unix_micros(F.col(col).cast("timestamp"))
    elif isinstance(kind, T.TimestampType):
        place = F.unix_micros(F.col(col))
    elif isinstance(kind, T.DateType):
        place = F.unix_date(F.col(col))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        # The first six bytes, as a number.
        place = F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 6)), 12, "0"), 16, 10)
    else:
        place = F.col(col)
    return F.coalesce(place.cast("double"), F.lit(float("-inf")))


@dataclass(frozen=True)
class Level:
    """Cuts of one order column: of all rows, or of the rows in the cells ``heavy`` alone."""

    col: str
    splits: tuple[float, ...]
    heavy: tuple[int, ...] = ()
    low: float = 0.0
    high: float = 0.0


def _bucket(df: DataFrame, col: str, out: str, splits: Sequence[float]) -> DataFrame:
    return Bucketizer(splits=list(splits), inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def _placed(df: DataFrame, level: Level) -> DataFrame:
    """``_q``: the position that a level cuts; NULL outside its heavy cells, whose number it starts with."""
    place = _position(df, level.col)
    if not level.heavy:
        return df.withColumn("_q", place)
    edges = [float("-inf"), *(e for c in level.heavy for e in (float(c), float(c + 1))), float("inf")]
    edges = [e for i, e in enumerate(edges) if i == 0 or e != edges[i - 1]]
    place_of = {e: i for i, e in enumerate(edges)}
    number = {place_of[float(c)]: i for i, c in enumerate(level.heavy)}
    df = _bucket(df.withColumn("_at", F.col(CELL).cast("double")), "_at", "_at_bucket", edges)
    # Positions among the edges and numbers of heavy cells are both small arrays of the plan.
    numbers = F.array(*[F.lit(number.get(i)).cast("double") for i in range(len(edges))])
    width = max(level.high - level.low, 1e-300) * (1 + 1e-9)
    share = (F.greatest(place, F.lit(level.low)) - level.low) / width
    return df.withColumn("_q", F.get(numbers, F.col("_at_bucket").cast("int")) + share).drop("_at", "_at_bucket")


def _in_cells(s: Series, levels: Sequence[Level]) -> DataFrame:
    df = s.df.withColumn(CELL, F.lit(0).cast("long"))
    for level in levels:
        df = _bucket(_placed(df, level), "_q", "_b", level.splits)
        inner = F.when(F.col("_q").isNotNull(), F.col("_b").cast("long")).otherwise(F.lit(0))
        df = df.withColumn(CELL, F.col(CELL) * (len(level.splits) + 1) + inner).drop("_q", "_b")
    return df


def _quantiles(df: DataFrame, col: str, rows: int, n: int) -> list[float]:
    """Values that cut ``rows`` rows into about ``n`` parts; one that fills parts is cut off on both sides."""
    if rows > SKETCH_ROWS:
        df = df.sample(fraction=SKETCH_ROWS / rows, seed=7)
    found = df.where(F.abs(col) < float("inf")).approxQuantile(col, [i / n for i in range(1, n)], 0.25 / n)
    often = {a for a, b in zip(found, found[1:]) if a == b}
    return sorted({*found, *(math.nextafter(v, math.inf) for v in often)})


def _cut(s: Series, total: int, limit: int) -> tuple[list[Level], DataFrame]:
    """Levels that leave no (key, cell) above ``limit`` rows but ties; and rows per key and cell."""
    keys, order, at = list(s.keys), list(s.order), 0
    first = s.df.select(_position(s.df, order[0]).alias("_q"))
    splits = _quantiles(first, "_q", total, max(2, min(MAX_CELLS, math.ceil(2 * total / limit))))
    levels = [Level(order[0], (float("-inf"), *splits, float("inf")))]
    while True:
        place = _position(s.df, order[at])
        cells = settled(_in_cells(s, levels).groupBy(*keys, CELL).agg(
            F.count(F.lit(1)).alias("_n"), F.min(place).alias("_lo"), F.max(place).alias("_hi")
        ))
        # At most total / limit cells are heavy.
        heavy = cells.where(F.col("_n") > limit).groupBy(CELL).agg(
            F.min("_lo").alias("lo"), F.max("_hi").alias("hi")
        ).collect()
        mixed = [r for r in heavy if r["lo"] != r["hi"]]
        if not mixed:  # whole values: the next order column takes over
            at += 1
        if not heavy or at == len(order) or len(levels) > 2 * len(order):
            return levels, cells.drop("_lo", "_hi")
        chosen = tuple(sorted(r[CELL] for r in (mixed or heavy)))
        rows = _in_cells(s, levels).where(F.col(CELL).isin(list(chosen))).select(
            CELL, *dict.fromkeys(order)
        )
        known = _position(rows, order[at])
        ends = rows.where(F.abs(known) < float("inf")).agg(F.min(known), F.max(known), F.count(F.lit(1))).first()
        level = Level(order[at], (), chosen, ends[0] or 0.0, ends[1] or 0.0)
        parts = math.ceil(2 * (ends[2] or 1) / limit) + len(chosen)
        inner = _quantiles(_placed(rows, level).select("_q"), "_q", ends[2] or 0, max(2, min(MAX_CELLS, parts)))
        splits = sorted({*inner, *(float(i) for i in range(1, len(chosen)))})
        levels.append(replace(level, splits=(float("-inf"), *splits, float("inf"))))


def planned(s: Series) -> Series:
    """Look at an unbounded series once, so that several operators can share the findings.

    Counts the rows and, if they exceed one segment, cuts the order into cells (a sample of at most
    about ``SKETCH_ROWS`` rows places their borders; every row is kept) and lays out the segments of
    the long keys, none longer than ``segment_rows`` (of a table beyond ``MAX_CELLS`` cells, than its
    share). The layout has about ``CELLS_PER_SEGMENT`` rows for each segment's worth of table
    rows; it is written to the shared folder, so later operators neither count again nor grow each
    other's plans. Without long keys the series is bounded, and operators take the plain way.
    """
    if s.bounded or s.layout is not None:
        return s
    total = s.df.count()
    if total <= s.segment_rows:
        return replace(s, max_rows=total)
    most = max(s.segment_rows, math.ceil(CELLS_PER_SEGMENT * total / MAX_CELLS))
    limit = max(1, 2 * most // CELLS_PER_SEGMENT)
    levels, cells = _cut(s, total, limit)
    rows = max(1, most - limit)  # a segment ends with the cell that reaches this many
    keys = list(s.keys)
    # At most one row per key and cell, whatever the key's length.
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    layout = (
        cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(per_key))
        .filter(F.col("_all") > most)
        .withColumn("_own", F.floor(F.col("_before") / rows))
        .withColumn(BASE, F.min("_before").over(Window.partitionBy(*keys, "_own")))
        .select(*keys, CELL, "_before", "_own", BASE)
    )
    layout = settled(layout)
    if layout.isEmpty():
        return replace(s, max_rows=most, segment_rows=most)
    return replace(s, splits=tuple(levels), layout=layout)


def settle(s: Series) -> Series:
    """Cut the lineage of an unbounded series before its rows feed several branches."""
    return s if s.bounded else s.on(settled(s.df))


def segment(s: Series, lookback: int = 0) -> Segments:
    """Split long keys so that any frame of ``lookback`` preceding rows is whole."""
    s = planned(s)
    if s.bounded:
        return Segments(s, s.df, list(s.keys), False)
    keys, layout = list(s.keys), s.layout
    placed = _in_cells(s, s.splits)
    copies = F.array("_own")
    if lookback:
        # Segments with a cell that starts within `lookback` rows of the next cell's start.
        order = Window.partitionBy(*keys).orderBy("_before")
        ahead = order.rangeBetween(0, lookback - 1)
        layout = layout.withColumn("_ahead", F.collect_set("_own").over(ahead))
        later = F.lead("_ahead").over(order)
        copies = F.array_distinct(F.concat(copies, F.coalesce(later, F.array().cast("array<bigint>"))))
    layout = layout.withColumn("_segs", copies).select(*keys, CELL, "_own", BASE, "_segs")
    zero = F.lit(0).cast("long")
    out = (
        placed.join(layout, [*keys, CELL], "left")
        .withColumn(SEG, F.explode(F.coalesce("_segs", F.array(zero))))
        .withColumn(HOME, F.col(SEG) == F.coalesce("_own", zero))
        .withColumn(BASE, F.coalesce(BASE, zero))
        .drop("_own", "_segs")
    )
    return Segments(s, out, [*keys, SEG], True)


def windowed(
    s: Series, lookback: int, build: Callable[[WindowSpec], Mapping[str, Column]]
) -> DataFrame:
    """Add columns over frames that reach at most ``lookback`` rows back within a key."""
    seg = segment(s, lookback)
    return seg.finish(seg.df.withColumns(dict(build(seg.window()))))


def carried(
    seg: Segments,
    summary: Mapping[str, Column],
    combine: Callable[[str, WindowSpec], Column],
    forward: bool = True,
) -> DataFrame:
    """Join to every row the combined summaries of the segments before (or after) its own."""
    keys = list(seg.s.keys)
    along = Window.partitionBy(*keys).orderBy(F.col(SEG) if forward else F.col(SEG).desc())
    along = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = seg.df.filter(F.col(HOME)).groupBy(*keys, SEG).agg(
        *[c.alias(name) for name, c in summary.items()]
    )
    carry = carry.select(*keys, SEG, *[combine(n, along).alias(n) for n in summary])
    return seg.df.join(carry, [*keys, SEG], "left")


def fill(s: Series, values: Mapping[str, Column], forward: bool = True) -> DataFrame:
    """Last (or next) non-null of each value, in order, as new columns.

    The backward fill takes the last non-null over the descending order: Spark evaluates
    frames that shrink towards the end quadratically.
    """
    seg = segment(s)
    frame = seg.window(descending=not forward).rowsBetween(Window.unboundedPreceding, 0)
    if not seg.split:
        return seg.df.withColumns(
            {n: F.last(c, ignorenulls=True).over(frame) for n, c in values.items()}
        )
    place = F.struct(*s.order)
    pick = F.max_by if forward else F.min_by
    df = carried(
        seg,
        {f"_c_{n}": pick(c, F.when(c.isNotNull(), place)) for n, c in values.items()},
        lambda n, w: F.last(n, ignorenulls=True).over(w),
        forward,
    )
    df = df.withColumns(
        {
            n: F.coalesce(F.last(c, ignorenulls=True).over(frame), F.col(f"_c_{n}"))
            for n, c in values.items()
        }
    )
    return seg.finish(df.drop(*[f"_c_{n}" for n in values]))


def running(s: Series, sums: Mapping[str, Column] = (), maxima: Mapping[str, Column] = ()):
    """Running sums and running maxima from the start of each key up to the current row."""
    sums, maxima = dict(sums), dict(maxima)
    seg = segment(s)
    frame = seg.window().rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.sum(c).over(frame) for n, c in sums.items()}
    local |= {n: F.max(c).over(frame) for n, c in maxima.items()}
    if not seg.split:
        return seg.df.withColumns(local)
    df = seg.df
    df = carried(
        seg,
        {f"_c_{n}": F.sum(c) for n, c in sums.items()}
        | {f"_c_{n}": F.max(c) for n, c in maxima.items()},
        lambda n, w: (F.sum if n[3:] in sums else F.max)(n).over(w),
    )
    both = {}
    for n in sums:
        carry = F.col(f"_c_{n}")
        both[n] = F.when(carry.isNull(), local[n]).otherwise(
            carry + F.coalesce(local[n], F.lit(0))
        )
    for n in maxima:
        both[n] = F.greatest(local[n], F.col(f"_c_{n}"))
    return seg.finish(df.withColumns(both).drop(*[f"_c_{n}" for n in both]))


def numbered(s: Series, name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    seg = segment(s)
    rn = F.row_number().over(seg.window()).cast("long")
    if not seg.split:
        return seg.df.withColumn(name, rn)
    return seg.finish(seg.df.withColumn(name, F.col(BASE) + rn))


def attach(s: Series, stats: DataFrame, salts: int = 32) -> DataFrame:
    """Join one row of statistics per key to all rows of the key.

    Unbounded series salt the join, so that the rows of a hot key meet ``salts`` copies of its
    one statistics row in as many tasks. Nothing is broadcast by hint; the planner broadcasts
    ``stats`` by itself only where its measured size is under the configured threshold.
    """
    keys = list(s.keys)
    if s.bounded:
        return s.df.join(stats, keys, "left")
    spread = F.pmod(F.xxhash64(*s.order), F.lit(salts)).cast("int")
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return s.df.withColumn("_salt", spread).join(copies, [*keys, "_salt"], "left").drop("_salt")


def with_stats(s: Series, stats: Mapping[str, Column]) -> DataFrame:
    """Add per-key aggregates to every row.

    On a bounded series they are whole-partition windows and share the one shuffle on the key
    with the windows around them; otherwise a partial aggregation and a salted join.
    """
    if s.bounded:
        whole = Window.partitionBy(*s.keys)
        return s.df.withColumns({n: c.over(whole) for n, c in stats.items()})
    agg = s.df.groupBy(*s.keys).agg(*[c.alias(n) for n, c in stats.items()])
    return attach(s, agg)

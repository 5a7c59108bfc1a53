"""Missing values, outlier detection and treatment, per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip
from tidemark.operators.quantiles import quantiles, value_ranks, with_quantiles
from tidemark.plans.segments import attach, fill, planned, settle, with_stats
from tidemark.plans.series import Series, numeric_columns
from tidemark.session import settled

# Fixed value: the 97.5 % and 50 % points of the chi-square distribution with one degree.
CHI2_975, CHI2_500 = 5.023886187314888, 0.454936423119572


def _measures(s: Series) -> list[str]:
    return numeric_columns(s.df, exclude=(*s.keys, s.ds, *s.seq))


# --- missing values -----------------------------------------------------------------------


def drop_missing(s: Series, subset: Sequence[str] | None = None) -> Series:
    return s.filtered(s.df.na.drop("any", subset=list(subset) if subset else None))


def impute(s: Series) -> Series:
    """Target by its mean, every other numeric column by its median."""
    others = [c for c in _measures(s) if c != s.y]
    df = with_stats(s, {"_fill_y": F.avg(s.y)})
    if others:
        df = with_quantiles(s.on(df), {f"_fill_{c}": (c, 0.5) for c in others})
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")) for c in others}
    filled[s.y] = F.coalesce(s.y, "_fill_y")
    return s.on(df.withColumns(filled).drop("_fill_y", *[f"_fill_{c}" for c in others]))


def forward_fill(s: Series, cols: Sequence[str] | None = None) -> Series:
    return s.on(fill(s, {c: F.col(c) for c in cols or _fillable(s)}, forward=True))


def backward_fill(s: Series, cols: Sequence[str] | None = None) -> Series:
    return s.on(fill(s, {c: F.col(c) for c in cols or _fillable(s)}, forward=False))


def _fillable(s: Series) -> list[str]:
    return [c for c in s.df.columns if c not in (*s.keys, s.ds, *s.seq)]


def interpolate(s: Series, cols: Sequence[str] | None = None) -> Series:
    """Linear in elapsed time between known values; edges take the nearest known value."""
    s = planned(s)
    cols = list(cols or _measures(s))

    def known(c: str) -> Column:
        return F.when(
            F.col(c).isNotNull(),
            F.struct(F.unix_micros(F.col(s.ds).cast("timestamp")).alias("t"), F.col(c).cast("double").alias("x")),
        )

    df = fill(s, {f"_p_{c}": known(c) for c in cols}, forward=True)
    df = fill(settle(s.on(df)), {f"_n_{c}": known(c) for c in cols}, forward=False)
    now = F.unix_micros(F.col(s.ds).cast("timestamp"))
    out = {}
    for c in cols:
        before, after = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        share = F.try_divide((now - before["t"]).cast("double"), (after["t"] - before["t"]).cast("double"))
        between = before["x"] + share * (after["x"] - before["x"])
        out[c] = F.coalesce(F.col(c).cast("double"), between, before["x"], after["x"])
    return s.on(df.withColumns(out).drop(*[f"_p_{c}" for c in cols], *[f"_n_{c}" for c in cols]))


MISSING: dict[str, Callable[[Series], Series]] = {
    "drop": drop_missing,
    "impute": impute,
    "interpolate": interpolate,
    **dict.fromkeys(("forward", "forward_fill", "ffill"), forward_fill),
    **dict.fromkeys(("backward", "backward_fill", "bfill"), backward_fill),
}


def handle_missing(s: Series, method: str = "impute") -> Series:
    if method not in MISSING:
        raise ValueError(f"unknown missing-value method {method!r}; one of {sorted(MISSING)}")
    return MISSING[method](s)


def impute_stats(s: Series) -> DataFrame:
    """Per key and column with gaps: how many values are imputed, how and with which value."""
    cols = _measures(s)
    others = [c for c in cols if c != s.y]
    keys = list(s.keys)
    counts = s.df.groupBy(*keys).agg(
        F.avg(s.y).alias(f"v_{s.y}"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols]
    )
    if others:
        counts = counts.join(quantiles(s, {f"v_{c}": (c, 0.5) for c in others}), keys)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit("mean" if c == s.y else "median").alias("method"),
                F.col(f"n_{c}").alias("filled"),
                F.col(f"v_{c}").alias("fill_value"),
            )
            for c in cols
        ]
    )
    return counts.select(*keys, F.inline(rows)).filter("filled > 0")


def fill_stats(before: Series, after: Series, cols: Sequence[str] | None = None) -> DataFrame:
    """NULLs before and after a fill, per key and column."""
    cols = list(cols or _measures(before))
    keys = list(before.keys)

    def nulls(s: Series, name: str) -> DataFrame:
        agg = s.df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        return agg.unpivot(keys, cols, "column", name)

    both = nulls(before, "missing_before").join(nulls(after, "missing_after"), [*keys, "column"])
    return both.withColumn("filled", F.col("missing_before") - F.col("missing_after"))


# --- outlier detectors: each adds the boolean column is_outlier ------------------------------


def _flag(df: DataFrame, test: Column, *helpers: str) -> DataFrame:
    return df.withColumn("is_outlier", F.coalesce(test, F.lit(False))).drop(*helpers)


def zscore_outliers(s: Series, threshold: float = 3.0) -> Series:
    """|x - mean| over the population deviation beyond the threshold; a constant has none."""
    df = with_stats(s, {"_m": F.avg(s.y), "_sd": F.stddev_pop(s.y)})
    z = F.try_divide(F.abs(F.col(s.y) - F.col("_m")), F.col("_sd"))
    return s.on(_flag(df, z > threshold, "_m", "_sd"))


def iqr_outliers(s: Series, multiplier: float = 1.5) -> Series:
    df = with_quantiles(s, {"_q1": (s.y, 0.25), "_q3": (s.y, 0.75)})
    reach = (F.col("_q3") - F.col("_q1")) * multiplier
    test = (F.col(s.y) < F.col("_q1") - reach) | (F.col(s.y) > F.col("_q3") + reach)
    return s.on(_flag(df, test, "_q1", "_q3"))


def envelope_outliers(s: Series, contamination: float = 0.1) -> Series:
    """Robust distance from the univariate minimum covariance determinant.

    The location is the midpoint of the shortest half. Scale is the variance of the values at
    least as near as the half-th nearest, corrected for consistency, then reweighted once. All
    order statistics come from distributed rank tables; the half's far end is an as-of lookup
    by rank, so no group is gathered.
    """
    s = planned(s)
    keys = list(s.keys)

    def kept(df: DataFrame) -> DataFrame:
        """Tables that several branches read start a new plan where rows are unbounded."""
        return df if s.bounded else settled(df)

    ranks = kept(value_ranks(s, s.y))
    half = F.ceil((F.col("n") + 2) / 2)
    ends = ranks.select(
        *keys, F.col("lo").alias("rank"), F.lit(0).alias("side"), F.col("v").alias("at"),
        F.lit(None).cast("double").alias("start"),
    )
    starts = ranks.filter(F.col("lo") + half < F.col("n")).select(
        *keys, (F.col("lo") + half).alias("rank"), F.lit(1).alias("side"),
        F.lit(None).cast("double").alias("at"), F.col("v").alias("start"),
    )
    # Up to two rows for each row of the bounded case.
    wide = s.reordered(
        ends.unionByName(starts), "rank", ("side", "start"),
        max_rows=2 * s.max_rows if s.bounded else None,
    )
    spans = fill(wide, {"end": F.col("at")}).filter("side = 1").select(
        *keys, "start", (F.col("end") - F.col("start")).alias("len"),
        ((F.col("end") + F.col("start")) / 2).alias("mid"),
    )
    # Spans of equal length are as many as distinct values: the mean of their middles is
    # taken per length first, so the shortest length's mean is one row per key.
    lengths = spans.groupBy(*keys, "len").agg(F.avg("mid").alias("mid"))
    shortest = lengths.groupBy(*keys).agg(F.min_by("mid", "len").alias("_loc"))
    every = s.df.groupBy(*keys).agg(F.avg(s.y).alias("_avg"))
    centre = every.join(shortest, keys, "left").select(*keys, F.coalesce("_loc", "_avg").alias("_loc"))
    dev = s.on(kept(attach(s, kept(centre)).withColumn("_dev", F.abs(F.col(s.y) - F.col("_loc")))))

    def at_rank(k: Column) -> Column:
        return F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("v")))

    n = F.col("n")
    near = kept(value_ranks(dev, "_dev"))
    core = near.groupBy(*keys).agg(
        F.coalesce(at_rank(F.ceil((n + 2) / 2) - 1), F.max("v")).alias("_reach"),
        ((F.pow(at_rank(F.floor((n - 1) / 2)), 2) + F.pow(at_rank(F.floor(n / 2)), 2)) / 2).alias("_med2"),
    )
    dev = s.on(attach(dev, kept(core)))
    dev = s.on(with_stats(dev, {"_var": F.var_pop(F.when(F.col("_dev") <= F.col("_reach"), F.col(s.y)))}))
    # Consistency: the median squared distance is scaled to that of a normal distribution.
    scale = F.try_divide(F.col("_med2"), F.col("_var")) / CHI2_500
    weighed = F.try_divide(F.try_divide(F.col("_dev") * F.col("_dev"), F.col("_var")), scale)
    good = F.when(weighed < CHI2_975, F.col(s.y))
    dev = s.on(with_stats(dev, {"_loc2": F.avg(good), "_var2": F.var_pop(good)}))
    dist = F.try_divide(F.pow(F.col(s.y) - F.col("_loc2"), 2), F.col("_var2"))
    dev = s.on(kept(dev.df.withColumn("_dist", dist)))
    df = with_quantiles(dev, {"_cut": ("_dist", 1 - contamination)})
    helpers = ("_loc", "_dev", "_reach", "_med2", "_var", "_loc2", "_var2", "_dist", "_cut")
    return s.on(_flag(df, F.col("_dist") > F.col("_cut"), *helpers))


TREES, TREE_ROWS = 100, 256


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points of a binary tree."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    deep = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _tree_steps(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One random isolation tree over sorted scalars, as steps: left edges and path lengths."""
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    edges, depths, todo = [], [], [(0, len(sample), 0, -np.inf)]
    while todo:
        a, b, depth, left = todo.pop()
        low, high = sample[a], sample[b - 1]
        if depth >= limit or b - a <= 1 or low == high:
            edges.append(left)
            depths.append(depth + float(_average_path(b - a)))
            continue
        cut = rng.uniform(low, high)
        mid = a + int(np.searchsorted(sample[a:b], cut, side="right"))
        mid = min(max(mid, a + 1), b - 1)
        todo += [(a, mid, depth + 1, left), (mid, b, depth + 1, float(sample[mid]))]
    at = np.argsort(edges)
    return np.asarray(edges)[at], np.asarray(depths)[at]


def _forest_steps(key_cols: list[str], seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def build(pool: pd.DataFrame) -> pd.DataFrame:
        # Sorted first: the pool arrives in shuffle order, and results must not depend on it.
        rng = np.random.default_rng(seed)
        if pool["tree"].iloc[0] < 0:  # all rows of a short key: each tree chooses among them
            x = np.sort(pool["y"].to_numpy(dtype=float))
            samples = [rng.choice(x, min(TREE_ROWS, len(x)), replace=False) for _ in range(TREES)]
        else:
            drawn = pool.sort_values(["tree", "rank", "y"]).drop_duplicates(["tree", "rank"])
            samples = [g["y"].to_numpy(dtype=float)[:TREE_ROWS] for _, g in drawn.groupby("tree")]
        trees = [_tree_steps(np.sort(x), rng) for x in samples]
        edges = np.unique(np.concatenate([e for e, _ in trees]))
        depth = np.zeros(len(edges))
        for e, d in trees:
            depth += d[np.searchsorted(e, edges, side="right") - 1]
        scale = max(float(_average_path(max(map(len, samples)))), 1e-12)
        out = pd.DataFrame({"lo": edges, "score": -np.power(2.0, -depth / len(trees) / scale)})
        for k in key_cols:
            out[k] = pool[k].iloc[0]
        return out

    return build


def _uniform(seed: int, *cols) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def forest_pool(s: Series, seed: int = 42) -> DataFrame:
    """Rows for the trees of each key: keys, ``y``, ``tree``, ``rank``.

    A short key (at most ``TREES * TREE_ROWS`` known rows) sends all its rows, for tree -1. Of a long
    key each tree has a sample of its own: a row is drawn a Poisson number of times, each time for a
    random tree with a random rank, so trees draw independently and twice what they need, and each
    takes its ``TREE_ROWS`` lowest ranks. That is about ``2 * TREES * TREE_ROWS`` rows a key, whatever
    its length; a row that no tree draws costs one hash.
    """
    keys = list(s.keys)
    known = s.df.filter(F.col(s.y).isNotNull())
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rate = F.lit(2.0 * TREES * TREE_ROWS) / F.col("_n")
    u = _uniform(seed, *s.order)
    none = F.exp(-rate)
    more = F.aggregate(
        F.sequence(F.lit(1), F.lit(30)),
        F.struct(none.alias("p"), none.alias("c"), F.lit(0).alias("m")),
        lambda a, j: F.struct(
            (a["p"] * rate / j).alias("p"), (a["c"] + a["p"] * rate / j).alias("c"),
            (a["m"] + F.when(u > a["c"], 1).otherwise(0)).alias("m"),
        ),
        lambda a: a["m"],
    )
    times = F.when(F.col("_n") <= TREES * TREE_ROWS, F.lit(-1)).when(u <= none, F.lit(0)).otherwise(more)
    # A short key's rows go out once, as draw 0.
    draws = F.when(F.col("_n") <= TREES * TREE_ROWS, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), times))
    rows = attach(s.on(known), counts).withColumn("_times", times).where("_times != 0").withColumn("_draw", F.explode(draws))
    tree = F.floor(_uniform(seed + 1, "_draw", *s.order) * TREES).cast("int")
    return rows.select(
        *keys, F.col(s.y).cast("double").alias("y"), F.when(F.col("_draw") == 0, F.lit(-1)).otherwise(tree).alias("tree"),
        F.xxhash64(F.lit(seed + 2), "_draw", *s.order).alias("rank"),
    )


def forest_scores(s: Series, seed: int = 42) -> Series:
    """Isolation score of every row (lower is more isolated).

    In one dimension a forest is a step function. It is grown per key from the rows that its trees
    draw, a bounded number. Rows then find their step by an as-of fill over the value order.
    """
    keys = list(s.keys)
    known = s.df.filter(F.col(s.y).isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    schema = "lo double, score double, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    steps = forest_pool(s, seed).groupBy(*keys).applyInPandas(_forest_steps(keys, seed), schema)
    # Values are scored once per distinct value, then joined back on (key, value).
    points = known.groupBy(*keys, F.col(s.y).cast("double").alias("v")).agg(F.lit(1).alias("side"))
    marks = steps.select(*keys, F.col("lo").alias("v"), F.lit(0).alias("side"), "score")
    marks = marks.unionByName(points.withColumn("score", F.lit(None).cast("double")))
    # A tree has fewer steps than rows.
    line = s.reordered(
        marks, "v", ("side",), max_rows=s.max_rows + TREES * TREE_ROWS if s.bounded else None
    )
    scored = fill(line, {"score": F.col("score")}).filter("side = 1").select(*keys, "v", "score")
    df = s.df.withColumn("v", F.col(s.y).cast("double")).join(scored, [*keys, "v"], "left").drop("v")
    return s.on(df)


def forest_outliers(s: Series, contamination: float = 0.1, seed: int = 42) -> Series:
    """The share ``contamination`` of each key's rows with the lowest isolation scores."""
    scored = settle(forest_scores(planned(s), seed))
    df = with_quantiles(scored, {"_cut": ("score", contamination)})
    return s.on(_flag(df, F.col("score") < F.col("_cut"), "_cut", "score"))


DETECTORS: dict[str, Callable[..., Series]] = {
    "zscore": zscore_outliers,
    "iqr": iqr_outliers,
    "isolation_forest": forest_outliers,
    "elliptic_envelope": envelope_outliers,
}


# --- treatments -----------------------------------------------------------------------------


def remove_outliers(s: Series) -> Series:
    return s.filtered(s.df.filter(~F.col("is_outlier")))


def clip_outliers(s: Series, low: float = 0.01, high: float = 0.99) -> Series:
    """Flagged rows only are clipped to two quantiles of the whole column."""
    df = with_quantiles(s, {"_lo": (s.y, low), "_hi": (s.y, high)})
    value = F.when(F.col("is_outlier"), clip(F.col(s.y), F.col("_lo"), F.col("_hi")))
    return s.on(df.withColumn(s.y, value.otherwise(F.col(s.y))).drop("_lo", "_hi"))


def winsorize(s: Series, low: float = 0.01, high: float = 0.01) -> Series:
    """The lowest and highest shares of rows take the next order statistic.

    Setting the lowest k rows to the value at rank k is clipping at that value, so only two
    order statistics per key are needed.
    """
    keys = list(s.keys)
    ranks = value_ranks(s, s.y)
    k_low = F.floor(F.col("n") * low)
    k_high = F.col("n") - 1 - F.floor(F.col("n") * high)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("v")))

    bounds = ranks.groupBy(*keys).agg(at(k_low).alias("_lo"), at(k_high).alias("_hi"))
    df = attach(s, bounds)
    return s.on(
        df.withColumn(s.y, clip(F.col(s.y), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    )


TREATMENTS: dict[str, Callable[[Series], Series]] = {
    "clip": clip_outliers,
    "remove": remove_outliers,
    "winsorize": winsorize,
}


def handle_outliers(s: Series, method: str = "zscore", treatment: str = "clip") -> Series:
    if method == "none":
        return s
    if method not in DETECTORS:
        raise ValueError(f"unknown outlier method {method!r}; one of {sorted(DETECTORS)}")
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment!r}; one of {sorted(TREATMENTS)}")
    flagged = DETECTORS[method](s)
    if treatment == "winsorize":
        # A key without outliers stays as it is: the shares would touch its regular values.
        marked = with_stats(flagged, {"_any": F.max(F.col("is_outlier").cast("int"))})
        treated = winsorize(flagged.on(marked.withColumn("_was", F.col(s.y))))
        value = F.when(F.col("_any") == 1, F.col(s.y)).otherwise(F.col("_was"))
        treated = treated.on(treated.df.withColumn(s.y, value).drop("_any", "_was"))
    else:
        treated = TREATMENTS[treatment](flagged)
    return s.on(treated.df.drop("is_outlier"))


def outlier_stats(flagged: Series) -> DataFrame:
    """Count, minimum, maximum and mean of the flagged values."""
    bad = F.when(F.col("is_outlier"), F.col(flagged.y))
    return flagged.df.groupBy(*flagged.keys).agg(
        F.count(bad).alias("n_outliers"),
        F.min(bad).alias("min_outlier"),
        F.max(bad).alias("max_outlier"),
        F.avg(bad).alias("mean_outlier"),
    )


def clean(
    s: Series, missing: str = "impute", outliers: str = "zscore", treatment: str = "clip"
) -> Series:
    """Missing values first, then outliers of the target."""
    return handle_outliers(handle_missing(s, missing), outliers, treatment)

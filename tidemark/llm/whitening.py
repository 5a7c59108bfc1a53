"""Whitening of embeddings over their distinct vectors, with multiplicities as fit weights.

1. Entries become whole numbers, and equal vectors one row with their count. Partial counts combine
   before the shuffle, so a vector that a third of all rows hold is no hot group.
2. Tasks add up weighted sums exactly; then, with the mean known, cross products of centred
   vectors (one matrix product per Arrow batch). What meets is one vector or matrix per task.
3. The driver takes eigenvectors of one matrix of dimension x dimension, whatever the number of rows.
4. Each distinct vector is projected once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settled

LEVELS = 256  # steps per unit of an entry
SAFE = 2.0**62  # whole numbers below it add up in 64 bits
WHOLE = pa.decimal128(38, 0)


def whole_vector(vector: Column, levels: int = LEVELS) -> Column:
    """floor(levels * entry) of every entry; NULL for a NULL vector or one with NULL, NaN or infinite entries."""
    known = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(known, F.transform(vector, lambda c: F.floor(c.cast("double") * levels).cast("long")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact(x: np.ndarray, bound: float) -> np.ndarray:
    """``x`` as 64-bit numbers if what is made of it stays below ``bound``, else as Python's own."""
    return x if bound < SAFE else x.astype(object)


def _column_sums(table: DataFrame, size: int) -> tuple[int, list[int]]:
    """Total weight and weighted sum of every dimension, exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (size + 1)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, w = _matrix(batch["x"], size), batch["weight"].to_numpy()
            most = float(np.abs(x.astype(float)).max()) * float(w.sum())
            x = _exact(x, most)
            for k, s in enumerate([w.sum(), *(w.astype(x.dtype) @ x)]):
                total[k] += int(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size + 1), pa.int32()), pa.array([Decimal(t) for t in total], WHOLE)], ["k", "total"]
        )

    rows = table.select("x", "weight").mapInArrow(sums, "k int, total decimal(38,0)")
    found = {r["k"]: int(r["total"]) for r in rows.groupBy("k").agg(F.sum("total").alias("total")).collect()}
    return found.get(0, 0), [found.get(k + 1, 0) for k in range(size)]


class _Centre:
    """Exact mean sums / n: subtracting its whole part first keeps all digits of the spread."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        self.rest = np.array([float(s - n * int(c)) / n for s, c in zip(sums, self.whole)])

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest


def _covariance(table: DataFrame, size: int, n: int, centre: _Centre) -> np.ndarray:
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = centre.off(_matrix(batch["x"], size))
            total += (y * batch["weight"].to_numpy()[:, None]).T @ y
        flat = pa.array(total.ravel())
        rows = pa.ListArray.from_arrays(pa.array(range(0, size * size + 1, size), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), rows], ["i", "products"])

    parts = table.select("x", "weight").mapInArrow(products, "i int, products array<double>")
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"))
    found = np.zeros((size, size))
    for row in summed.collect():
        found[row["i"]] = row["products"]
    return (found + found.T) / (2 * n)


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit eigenvectors (columns), at most ``most``, none without variance.

    The entry of largest size is positive in each.
    """
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    real = values > max(values.max(initial=0.0), 0.0) * len(covariance) * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(0, keepdims=True), 0)
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest difference of the whitened vectors' covariance from the identity, over the fit list."""
    if k == 0:
        return 0.0
    w = F.col("weight").cast("double")
    at = [F.get("scores", F.lit(i)) for i in range(k)]
    means = white.agg(*[F.sum(w * a) / n for a in at]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = white.agg(*[F.sum(w * (at[i] - means[i]) * (at[j] - means[j])) / n for i, j in pairs]).first()
    return max(abs(s - (i == j)) for (i, j), s in zip(pairs, sums))


def whiten(
    vectors: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",),
    weight: str = "one", components: int = 4, levels: int = LEVELS,
) -> DataFrame:
    """Scores of unit variance, without correlation, for every row with a whole vector.

    ``carry``, ``component`` (int, from 1 by falling eigenvalue), ``n`` (weight of the fit list),
    ``deviation`` (decimal: exact sum over dimensions of (n * x - sum)^2), ``whitened``, ``explained``
    (share of the whole variance) and ``identity_error`` (one value). ``weight`` is 'one' (each
    distinct vector counts once) or 'count' (as often as it occurs).

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries stay out; so do those of
    another length than most rows have (of two such lengths, the larger counts). Repeated rows each
    give rows, NULL ids too. Directions without variance are no components; so one distinct vector,
    or none, gives an empty result. Extra columns are ignored, and ``carry`` may have any name but
    those of the result.
    """
    if weight not in ("one", "count"):
        raise ValueError("weight is 'one' or 'count'")
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = vectors.select(*kept, whole_vector(F.col(f"`{vector}`"), levels).alias("x")).where("size(x) > 0")
    rows = rows.withColumn("h", F.xxhash64("x"))
    distinct = rows.groupBy("h", "x").agg(F.count(F.lit(1)).alias("weight"))
    distinct = settled(distinct.withColumn("rows", F.col("weight")))
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("rows").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + (
        ", component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["d"]
    distinct = distinct.where(F.size("x") == size)
    if weight == "one":
        distinct = distinct.withColumn("weight", F.lit(1).cast("long"))
    n, sums = _column_sums(distinct, size)
    centre = _Centre(n, sums)
    covariance = _covariance(distinct, size, n, centre)
    values, directions = principal(covariance, components)
    scaled = directions / np.sqrt(values)
    whole_sums = np.array(sums, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch["x"], size)
            y = centre.off(x)
            far = _exact(x, max(float(np.abs(y).max()) ** 2 * size * float(n) ** 2, float(np.abs(x.astype(float)).max()) * n))
            far = n * far - whole_sums.astype(far.dtype) if far.dtype != object else n * far - whole_sums
            square = [int(s) for s in (far * far).sum(axis=1)]
            square = [Decimal(s) if s < 10**38 else None for s in square]
            scores = (y @ scaled).ravel()
            steps = pa.array(np.arange(0, len(scores) + 1, len(values)) if len(values) else np.zeros(len(x) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["h"], batch["x"], batch["weight"], pa.array(square, WHOLE), pa.ListArray.from_arrays(steps, pa.array(scores))],
                ["h", "x", "weight", "deviation", "scores"],
            )

    white = settled(distinct.select("h", "x", "weight").mapInArrow(
        project, "h long, x array<long>, weight long, deviation decimal(38,0), scores array<double>"
    ))
    error = _identity_error(white, n, len(values))
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values]).cast("array<double>")
    joined = rows.join(white.drop("weight"), ["h", "x"])
    return joined.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "deviation",
        F.posexplode("scores").alias("_at", "whitened"),
    ).select(
        *[f"`{c}`" for c in carry], (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("_at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

"""Principal components of feature columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import pairwise_correlations
from tidemark.plans.series import Series


def loadings(df: DataFrame, cols: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of the correlation matrix, largest first.

    Each correlation is taken over the rows that know both columns. A constant column correlates with
    nothing and has no spread. The first loading of a component that is not zero is positive.
    """
    r = pairwise_correlations(df, cols)
    varies = np.isfinite(np.diag(r))
    r = np.where(np.isfinite(r), (r + r.T) / 2, 0.0)
    np.fill_diagonal(r, varies.astype(float))
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = np.where(np.abs(vectors) < 1e-12, 0.0, vectors)[:, order]
    first = np.take_along_axis(vectors, (vectors != 0).argmax(0, keepdims=True), 0)
    return values[order], vectors * np.where(first < 0, -1.0, 1.0)


def principal_components(s: Series, cols: Sequence[str], k: int) -> DataFrame:
    """``pc_1 .. pc_k`` of the standardised columns, over all keys; every row stays.

    Standardised by mean and sample deviation of the known values. A score adds up the columns that a
    row knows, so an unknown one counts as its mean; a row that knows none of the columns that vary
    has NULL scores.
    """
    if not 1 <= k <= len(cols):
        raise ValueError("k lies between 1 and the number of columns")
    _, vectors = loadings(s.df, cols, k)

    def known(c: str):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    stats = s.df.agg(*[f(known(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    scaled = []
    for i, c in enumerate(cols):
        mean, spread = stats[f"m{i}"], stats[f"s{i}"]
        scaled.append((known(c) - F.lit(mean)) / F.lit(spread if spread else 1.0))
    some = F.coalesce(F.lit(None).cast("double"), *[known(c) for i, c in enumerate(cols) if stats[f"s{i}"]]).isNotNull()
    out = {}
    for j in range(k):
        terms = [F.coalesce(z * float(vectors[i, j]), F.lit(0.0)) for i, z in enumerate(scaled) if vectors[i, j]]
        out[f"pc_{j + 1}"] = F.when(some, sum(terms[1:], terms[0]))
    return s.df.withColumns(out)

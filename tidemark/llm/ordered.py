"""Documents in doc_id order across partitions, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES, MOST_PARTS = 16 << 20, 20_000  # beyond it parts grow; they are streamed


def in_parts(docs: DataFrame, descending: bool = False) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``docs`` (doc_id, text) with ``part``; and per part, in order, its number and first doc_id.

    Parts are ranges of doc_id with about ``PART_BYTES`` of text, numbered in the order asked for.
    Their borders are quantiles of doc_id, so any numbering of documents will do; rows of one doc_id
    share a part. What comes to the driver is two numbers per part.
    """
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(1, min(int((size or 0) // PART_BYTES), rows, MOST_PARTS))
    cuts: list[int] = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0]))
    borders = F.array(*map(F.lit, cuts)).cast("array<long>")
    below = F.size(F.filter(borders, lambda c: c < F.col("doc_id")))
    docs = docs.withColumn("part", (F.lit(len(cuts)) - below if descending else below).cast("int"))
    ends = docs.groupBy("part").agg((F.max if descending else F.min)("doc_id").alias("first"))
    return docs, [(r["part"], r["first"]) for r in ends.orderBy("part").collect()]

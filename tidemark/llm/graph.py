"""Connected components of an edge table, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, its component's smallest node, for every node of ``a``-``b`` edges.

    Each round hangs all neighbours of a node on their smallest one, first the larger, then the
    smaller neighbours; the number of rounds grows with the logarithm of a component's width.
    Each round is two aggregations and two joins, whose hot nodes Spark can split, and ends in a
    written table. Loops and NULLs are ignored; without edges the result is empty.
    """
    pairs = edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now, before = settled(pairs.distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("comp"))
            ).distinct()
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.where("u != v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())

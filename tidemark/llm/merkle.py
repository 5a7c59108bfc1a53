"""A Merkle tree over every row of a dataset, with the proof of each row, by a butterfly exchange.

1. Each row's leaf is the hash of its columns. Leaves are ranged by (group, doc_id) over partitions;
   counts of each partition give every leaf its place in its group.
2. ``FANOUT`` ** ``BLOCK_LEVELS`` leaves in a row, aligned, make a block: one row of bounded size whose
   lower subtree one task hashes.
3. Blocks meet in rounds. In round r, blocks whose numbers differ in digit r alone (to base
   ``FANOUT``) swap the roots of their subtrees; each hashes the parent by itself and notes its
   siblings. So after the last round every block has its own upper proof and the root, without a
   way down; no group holds more than ``FANOUT`` rows. The last subtree is filled up with blocks
   without a root, so that everyone finds partners for all digits.
4. Roots of the groups, in order of group, are the leaves of one more tree, built the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settled

FANOUT, BLOCK_LEVELS = 3, 5
POWERS = [FANOUT**k for k in range(40)]
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(*columns: Column) -> Column:
    """Hash of values that each say their length; ``-`` stands for NULL."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to with the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def siblings_hash(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves: list[str], height: int) -> list[list[str]]:
    """The nodes of ``height`` levels above ``leaves``, those first."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([_digest(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes: the least h with FANOUT ** h >= n."""
    powers = F.array(*[F.lit(p).cast("decimal(38,0)") for p in POWERS])
    return F.size(F.filter(powers, lambda p: p < n))


def _placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place within ``key``, and ``n``, the leaves of ``key``.

    Rows are ranged by (key, order); ties between equal rows are broken by where they come from.
    What a key's window sees is one row per partition.
    """
    told = settled(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    by = ["key", *order, "_tie"]
    ranged = told.repartitionByRange(*by).sortWithinPartitions(*by)
    low = F.lit((1 << 33) - 1)  # a monotonic id is the partition's number and, in 33 bits, the row's in it
    ranged = settled(ranged.select(
        *leaves.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(low).alias("_at")
    ))
    parts = ranged.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "key", "_part", (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_count").over(Window.partitionBy("key")).alias("n"),
    )
    return ranged.join(parts, ["key", "_part"]).select(*leaves.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heights = batch["height"].to_pylist()
        roots = [_levels(x, h)[-1][0] for x, h in zip(batch["digests"].to_pylist(), heights)]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], batch["blocks"], pa.array(roots, pa.string())], ["key", "block", "blocks", "digest"])


def _block_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``proof`` of every row of a block: its siblings within the block, then the block's own."""
    for batch in batches:
        left, right, sizes, counts = [], [], [], []
        rows = zip(batch["digests"].to_pylist(), batch["height"].to_pylist(), batch["up"].to_pylist())
        for leaves, height, up in rows:
            levels = _levels(leaves, height)
            up_left, up_right = [s["left"] for s in up], [s["right"] for s in up]
            for i in range(len(leaves)):
                for nodes in levels[:-1]:
                    run = i - i % FANOUT
                    left.append("".join(nodes[run:i]))
                    right.append("".join(nodes[i + 1 : run + FANOUT]))
                    i //= FANOUT
                left += up_left
                right += up_right
            sizes += [height + len(up)] * len(leaves)
            counts.append(len(leaves))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(STEP))
        proofs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), steps)
        proofs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), proofs)
        yield pa.RecordBatch.from_arrays([batch["rows"], batch["root"], proofs], ["rows", "root", "proofs"])


def _butterfly(blocks: DataFrame) -> DataFrame:
    """``key``, ``block``, ``up`` (siblings above the block, from below) and ``root`` of its key.

    ``blocks`` has key, block, blocks (their number in the key) and digest (root of the block).
    """
    rounds = _height(F.col("blocks"))
    # The last of the top node's subtrees is filled up, so all its members have all partners.
    wide = F.get(F.array(*[F.lit(p).cast("decimal(38,0)") for p in POWERS]), rounds - 1).cast("long")
    full = F.when(F.col("blocks") > 1, F.ceil(F.col("blocks") / wide) * wide).otherwise(F.col("blocks"))
    fill = blocks.where("block = 0").select("key", "blocks", full.alias("full")).where("full > blocks")
    fill = fill.select(
        "key", F.explode(F.sequence("blocks", F.col("full") - 1)).alias("block"), "blocks", F.lit(None).cast("string").alias("digest")
    )
    now = blocks.select("key", "block", "blocks", "digest").unionByName(fill)
    now = now.withColumns({"rounds": _height(F.col("blocks")), "up": F.array().cast(STEPS)})
    for r in range(blocks.agg(F.max(rounds)).first()[0] or 0):
        step = FANOUT**r
        active = F.col("rounds") > r
        high = F.when(active, F.floor(F.col("block") / (step * FANOUT))).otherwise(F.col("block"))
        low = F.when(active, F.col("block") % step).otherwise(F.lit(0))
        groups = now.groupBy("key", "blocks", "rounds", high.alias("_high"), low.alias("_low")).agg(
            F.sort_array(F.collect_list(F.struct("block", "digest", "up"))).alias("_all")
        )
        met = groups.withColumn("_digests", F.col("_all.digest")).select(
            "*", F.posexplode("_all").alias("_i", "_m"), F.array_compact("_digests").alias("_known")
        )
        own = F.struct(
            F.array_join(F.slice("_digests", F.lit(1), F.col("_i")), "").alias("left"),
            F.array_join(F.slice("_digests", F.col("_i") + 2, F.lit(FANOUT)), "").alias("right"),
        )
        parent = F.when(F.size("_known") > 0, F.sha2(F.array_join("_known", ""), 256))
        now = met.select(
            "key", F.col("_m.block").alias("block"), "blocks", "rounds",
            F.when(active, parent).otherwise(F.col("_m.digest")).alias("digest"),
            F.when(active, F.concat("_m.up", F.array(own))).otherwise(F.col("_m.up")).alias("up"),
        )
    return now.where("block < blocks").select("key", "block", "up", F.col("digest").alias("root"))


def forest(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """One tree per ``key`` (never NULL) over its leaves (``digest``) sorted by ``order``.

    The columns of ``leaves``, ``proof`` (per level, from below: digests ``left`` and ``right`` of
    the path, joined) and ``root``. A lone leaf is its root and has an empty proof.
    """
    size = FANOUT**BLOCK_LEVELS
    placed = _placed(leaves, order).withColumn("block", F.floor(F.col("pos") / size))
    payload = F.struct("pos", *leaves.columns)
    blocks = placed.groupBy("key", "block", "n").agg(F.sort_array(F.collect_list(payload)).alias("rows"))
    blocks = settled(blocks.select(
        "key", "block", F.ceil(F.col("n") / size).alias("blocks"),
        F.least(_height(F.col("n")), F.lit(BLOCK_LEVELS)).alias("height"), "rows",
    ))
    heads = blocks.select("key", "block", "blocks", "height", F.col("rows.digest").alias("digests"))
    roots = settled(heads.mapInArrow(_block_roots, "key string, block long, blocks long, digest string"))
    upper = settled(_butterfly(roots))
    kinds = dict(blocks.dtypes)
    proved = blocks.join(upper, ["key", "block"]).select(
        F.col("rows.digest").alias("digests"), "height", "up", "rows", "root"
    ).mapInArrow(_block_proofs, f"rows {kinds['rows']}, root string, proofs array<{STEPS}>")
    return proved.select("root", F.explode(F.arrays_zip("rows", "proofs")).alias("_r")).select(
        *[F.col(f"_r.rows.`{c}`").alias(c) for c in leaves.columns], F.col("_r.proofs").alias("proof"), "root"
    )


def manifest(docs: DataFrame, group: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``group``, ``carry``, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row.

    Leaves hash ``COLUMNS``. Each group is a tree over its leaves by doc_id (NULL first; equal doc_ids
    by leaf); the groups' roots, NULL first and then by UTF-8 bytes, are the leaves of the last tree.
    ``proof`` leads from the leaf to ``root`` (see ``folded``).

    NULL values have a mark of their own in the leaf; rows with a NULL doc_id take part, and so does
    each repeated row. Extra columns are ignored but for ``carry``. An empty table gives no rows.
    """
    extra = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("key"),
        F.col("doc_id").alias("_id"), F.col(f"`{group}`").alias("_group"), *extra,
        leaf_hash(*[F.col(c) for c in COLUMNS]).alias("digest"),
    )
    lower = settled(forest(leaves, ["_id", "digest"]))
    heads = lower.groupBy("key").agg(F.first("root").alias("digest"))
    heads = heads.select(F.lit("").alias("key"), F.col("key").alias("_key"), "digest")
    top = settled(forest(heads, ["_key"])).select(
        F.col("_key").alias("key"), F.col("proof").alias("_above"), F.col("root").alias("_top")
    )
    return lower.join(top, "key").select(
        F.col("_id").alias("doc_id"), F.col("_group").alias(group), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("_top").alias("root"),
        F.concat("proof", "_above").alias("proof"),
    )

"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact confirmation.

1. Every text becomes its set of word shingles, as sorted 64-bit hashes, and a signature of
   ``HASHES`` minima. Equal sets collapse into one node, so copies cost nothing from here on.
2. Nodes that agree on all rows of a band share a bucket. A node's home is the pivot (smallest
   node) that it shares most buckets with; homes are cut into tiles of bounded size, each with a
   copy of the pivot. Sets are built again only for nodes that share a bucket.
3. Inside a tile, pairs that share a band are compared ``STEP`` minima at a time: once the
   posterior probability of a similarity at the threshold falls below ``MISS``, the pair goes.
   Survivors are confirmed on their full sets. Only links that join something leave the tile.
4. Components of those links. Then the nodes of every pivot, home or not, meet where they are not all one
   component: each pair that shares a bucket shares its pivot, and a pivot's nodes are far fewer than its
   buckets' entries. A group beyond one tile is cut by size of the sets, large components apart, and tiles
   meet only if their sizes allow a link. Pairs of one component are left out, so no link between
   different components is lost, and groups that hang together cost no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import documents_of, forget, settled
from tidemark.llm.graph import components

BANDS, ROWS, STEP = 25, 5, 25
HASHES = BANDS * ROWS
MISS = 1e-7
# Tiles of n nodes are loaded n / TILE_NODES times each if all must meet, so they are as large as a task
# holds with ease: two of 8 MB.
TILE_NODES, TILE_SHINGLES, APART = 1024, 1_000_000, 64
BROADCAST_NODES = 1_000_000  # of 24 bytes; beyond it the join is shuffled

SKETCH = "doc_id long, n_shingles long, node long, bands array<long>"
CONTENT = "node long, tile long, n_shingles long, sig binary, members binary"
PAIRS = "a long, b long"


def _set_of(run: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted distinct hashes and a hash of the whole set."""
    own = np.unique(run)
    return own, int(textvec.mix(textvec.mix(own ^ np.uint64(0xA5A5)).sum(keepdims=True) + np.uint64(len(own)))[0].astype(np.int64))


def _signature(own: np.ndarray) -> np.ndarray:
    flip, times = textvec.seeds(HASHES, 11)[:, None], (textvec.seeds(HASHES, 13) | np.uint64(1))[:, None]
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        np.minimum(low, ((own[at : at + 4096] ^ flip) * times).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(textvec.seeds(BANDS, 17), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = textvec.mix(key + parts[:, :, r])
    return key.astype(np.int64)


def _sets(batch: pa.RecordBatch, size: int):
    """Row number and set of each document of a batch."""
    with np.errstate(over="ignore"):
        for w in textvec.words(batch.column("text")):
            runs, first = textvec.shingles(w, size, short=True)
            for k in range(len(first) - 1):
                yield w.rows.start + k, *_set_of(runs[first[k] : first[k + 1]])


def sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        forget()
        for batch in batches:
            out = [
                (len(own), node, _bands(_signature(own))[0] if len(own) else [])
                for _, own, node in _sets(batch, size)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "node", "bands"],
            )

    return docs.mapInArrow(run, SKETCH)


def contents(docs: DataFrame, homes: DataFrame, size: int) -> DataFrame:
    """Sets and signatures of the nodes in ``homes``, from the text of one document each."""
    small = homes.count() <= BROADCAST_NODES
    wanted = homes.select(F.col("label").alias("doc_id"), "node", "tile")
    picked = docs.join(F.broadcast(wanted) if small else wanted, "doc_id")

    def run(batches):
        for batch in batches:
            rows, sigs, sets = [], [], []
            asked = batch.column("node").to_numpy()
            for row, own, node in _sets(batch, size):
                if node == asked[row]:  # a doc_id can come with several texts
                    rows.append(row)
                    sigs.append(_signature(own).tobytes())
                    sets.append(own.tobytes())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column("node"), kept.column("tile"), pa.array([len(s) // 8 for s in sets], pa.int64()),
                    pa.array(sigs, pa.binary()), pa.array(sets, pa.binary()),
                ],
                ["node", "tile", "n_shingles", "sig", "members"],
            )

    one_each = picked.mapInArrow(run, CONTENT)
    return one_each.groupBy("node", "tile").agg(
        *[F.first(c).alias(c) for c in ("n_shingles", "sig", "members")]
    )


def least_matches(share: float, miss: float) -> tuple[int, ...]:
    """Matches needed after each step: with fewer, P(similarity >= share) is below ``miss``.

    The prior is uniform, so after m matches of n the similarity is Beta(m + 1, n - m + 1).
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    need = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            mass = np.exp(logs - logs.max())
            if mass[x >= share].sum() / mass.sum() >= miss:
                break
        need.append(m)
    return tuple(need)


def confirm(left, right, comp_left, comp_right, percent: int, need: tuple[int, ...], same: bool) -> list[tuple[int, int]]:
    """Links (positions) that join different components, among pairs of two tiles' rows.

    ``left`` and ``right`` are (sizes, signatures, sets); ``same`` says they are one tile; ``need``
    are the ``least_matches``.
    """
    parent: dict[int, int] = {}

    def top(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    bands_left, bands_right = _bands(left[1]), _bands(right[1])
    links = []
    for i in range(len(left[0])):
        fits = (100 * np.minimum(left[0][i], right[0]) >= percent * np.maximum(left[0][i], right[0]))
        fits &= comp_left[i] != comp_right
        if same:
            fits[: i + 1] = False
        near = np.flatnonzero(fits)
        near = near[(bands_right[near] == bands_left[i]).any(axis=1)]
        match = np.zeros(len(near), np.int64)
        for k, least in enumerate(need):
            part = slice(k * STEP, (k + 1) * STEP)
            match = match + (right[1][near, part] == left[1][i, part]).sum(axis=1)
            near, match = near[match >= least], match[match >= least]
        own = left[2][i]
        for j in near[np.argsort(-match, kind="stable")]:
            p, q = top(comp_left[i]), top(comp_right[j])
            if p == q:
                continue
            other = right[2][j]
            at = np.searchsorted(own, other)
            both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
            if 100 * both >= percent * (len(own) + len(other) - both):
                parent[max(p, q)] = min(p, q)
                links.append((i, int(j)))
    return links


def _unpacked(rows: pd.DataFrame):
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, HASHES)
    return rows["n_shingles"].to_numpy(), sig, [np.frombuffer(x, np.uint64) for x in rows["members"]]


def _links(a: pd.DataFrame, b: pd.DataFrame, found) -> pd.DataFrame:
    i, j = [x[0] for x in found], [x[1] for x in found]
    return pd.DataFrame({"a": a["node"].to_numpy()[i], "b": b["node"].to_numpy()[j]}, dtype="int64")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``.

    Words are runs of non-blank bytes, A-Z folded; a document's set are its distinct runs of
    ``size`` words (the whole text, if it has fewer). Documents with 100 * intersection >=
    ``percent`` * union are linked; ``component_id`` is the smallest doc_id reachable.

    A NULL, empty or blank text has an empty set and is linked with nothing. Rows with a NULL
    doc_id stay out; rows that repeat a doc_id are documents of their own, each with a row. Extra
    columns are ignored; an empty table gives an empty result.
    """
    docs = documents_of(docs)
    need = least_matches(percent / 100, MISS)  # on the driver: tasks get the numbers
    each = settled(sketch(docs, size))
    nodes = each.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("label"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    buckets = nodes.select("node", "label", "n", F.explode("bands").alias("band"))
    pivots = each.where("n_shingles > 0").select("node", F.explode("bands").alias("band")).groupBy("band").agg(
        F.min("node").alias("pivot"), F.max("node").alias("last")
    ).where("pivot != last")
    shared = settled(buckets.join(pivots.drop("last"), "band"))
    votes = shared.groupBy("node", "label", "n", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    # A pivot's own buckets count only if it has no other pivot.
    rank = F.struct((F.col("pivot") != F.col("node")).alias("other"), "votes", "pivot")
    homes = votes.groupBy("node", "label", "n").agg(F.max(rank)["pivot"].alias("pivot"))
    cuts = homes.groupBy("pivot").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / TILE_NODES), F.ceil(F.sum("n") / TILE_SHINGLES)
        ).alias("cuts")
    )
    tile = F.xxhash64("pivot", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("long"))
    homes = settled(homes.join(cuts, "pivot").withColumn("tile", tile))
    content = settled(contents(docs, homes, size))

    every_cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    copies = cuts.select(F.col("pivot").alias("node"), every_cut.alias("cut")).select(
        "node", F.xxhash64("node", "cut").alias("at")
    )
    visiting = content.join(copies, "node").where("tile != at").drop("tile").withColumnRenamed("at", "tile")

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        side, own = _unpacked(rows), rows["node"].to_numpy()
        with np.errstate(over="ignore"):
            return _links(rows, rows, confirm(side, side, own, own, percent, need, True))

    first = settled(content.unionByName(visiting).groupBy("tile").applyInPandas(inside, PAIRS))
    comp = settled(components(first))

    members = votes.select("node", "n", "pivot").join(comp, "node", "left").select(
        "node", "n", "pivot", F.coalesce("comp", "node").alias("comp")
    )
    cuts = [F.ceil(F.count(F.lit(1)) / TILE_NODES), F.ceil(F.sum("n") / TILE_SHINGLES)]
    groups = members.groupBy("pivot").agg(
        F.greatest(*cuts).alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    ).where("lo != hi")
    members = settled(members.join(groups.select("pivot", "parts"), "pivot"))
    # A large component has tiles of its own, as its members need no comparison with each other.
    large = members.where("parts > 1").groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= APART)
    # Sets of linked nodes are at most two of these steps apart in size.
    width = max(math.log(100 / percent) / 2 * (1 + 1e-9), 1e-7)
    many, zero = F.col("parts") > 1, F.lit(0).cast("long")
    members = members.join(large, ["pivot", "comp"], "left").select(
        "node", "n", "pivot", "comp", F.when(F.col("c").isNotNull(), F.col("comp")).otherwise(zero).alias("kind"),
        F.when(many, F.floor(F.ln("n") / width)).otherwise(zero).alias("step"),
    )
    dealt = members.groupBy("pivot", "kind", "step").agg(F.greatest(*cuts).alias("cuts"))
    tile = F.xxhash64("pivot", "kind", "step", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("long"))
    placed = settled(
        members.join(dealt, ["pivot", "kind", "step"]).select("node", "comp", "pivot", "step", tile.alias("tile"))
    )
    tiles = settled(placed.groupBy("pivot", "step", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    fits = "abs(x.step - y.step) <= 2 AND least(x.lo, y.lo) != greatest(x.hi, y.hi)"
    meet = settled(
        tiles.alias("x").join(tiles.alias("y"), F.expr(f"x.pivot = y.pivot AND x.tile <= y.tile AND {fits}")).select(
            F.col("x.tile").alias("tile_a"), F.col("y.tile").alias("tile_b")
        )
    )
    loaded = content.drop("tile").join(placed.select("node", "comp", "tile"), "node")
    sides = [
        meet.where("tile_a != tile_b OR left").join(loaded.withColumnRenamed("tile", t), t).select(
            "tile_a", "tile_b", "left", "node", "comp", "n_shingles", "sig", "members"
        )
        for t, meet in (("tile_a", meet.withColumn("left", F.lit(True))), ("tile_b", meet.withColumn("left", F.lit(False))))
    ]

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["left"]], rows[~rows["left"]]
        same = b.empty  # a tile that meets itself comes once
        b = a if same else b
        left = _unpacked(a)
        with np.errstate(over="ignore"):
            found = confirm(
                left, left if same else _unpacked(b), a["comp"].to_numpy(), b["comp"].to_numpy(), percent, need, same
            )
        return _links(a, b, found)

    second = sides[0].unionByName(sides[1]).groupBy("tile_a", "tile_b").applyInPandas(across, PAIRS)
    links = settled(first.unionByName(second))
    comp = settled(components(links))

    whole = nodes.select("node", "label").join(comp, "node", "left").select(
        "node", "label", F.coalesce("comp", "node").alias("comp")
    )
    joined = whole.groupBy("comp").agg(F.min("label").alias("component_id"))
    named = whole.join(joined, "comp").select("node", "component_id")
    out = each.drop("bands").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )

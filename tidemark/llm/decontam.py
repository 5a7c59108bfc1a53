"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

1. A mask of ``MASKS`` keeps five positions of a span of words and ignores the others. Each span of
   each benchmark item gives one seed per mask: a hash of the words at the kept positions.
2. Documents' spans are hashed alike and kept where their hash is a seed. The distinct seeds are
   broadcast while there are at most ``BROADCAST_SEEDS``; a larger set is joined by shuffle.
3. Each hit fixes an alignment of an item with a document (no insertions). Aligned words are
   compared, and an alignment counts if ``window`` words in a row hold at least ``same`` equal ones:
   a substitution breaks a seed or two, but not the passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, settled

MASKS = ("110111", "1101011", "11001011")
SPAN = max(map(len, MASKS))
WINDOW, SAME = 13, 11
BROADCAST_SEEDS, BROADCAST_DOCS = 4_000_000, 1_000_000  # rows of 8 bytes
BREAKS = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), BREAKS), lambda w: w != "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _seeds(table: DataFrame, key: str) -> DataFrame:
    """``key``, word position ``at`` and ``seed`` for every span and mask of ``hashes``.

    Shifted copies of the array put the words of a span in one row, so the hashing is compiled.
    The last spans are padded with NULL; a mask that reaches beyond the end gives no seed.
    """
    shifted = [
        F.when(F.size("hashes") > k, F.slice("hashes", k + 1, F.greatest(F.size("hashes"), F.lit(1)))).alias(f"w{k}")
        if k else F.col("hashes").alias("w0")
        for k in range(SPAN)
    ]
    rows = table.where(F.size("hashes") >= min(map(len, MASKS))).select(
        key, *[F.coalesce(s, F.array().cast("array<long>")).alias(f"w{k}") for k, s in enumerate(shifted)]
    ).select(key, F.posexplode(F.arrays_zip(*[f"w{k}" for k in range(SPAN)])).alias("at", "w"))
    made = []
    for n, mask in enumerate(MASKS):
        kept = [F.col(f"w.w{k}") for k, bit in enumerate(mask) if bit == "1"]
        made.append(F.when(kept[-1].isNotNull(), F.xxhash64(F.lit(n), *kept)))
    return rows.select(key, "at", F.explode(F.array(*made)).alias("seed")).where("seed IS NOT NULL")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, same: int = SAME
) -> DataFrame:
    """One row per document and benchmark item that share a passage.

    ``doc_id``, ``item_id``, ``start`` and ``stop`` (words of the document, end exclusive, from the
    first passing window to the last of the best alignment), ``n_words`` and ``n_equal`` there.
    Words are runs of letters and digits in lower case; the best alignment has the most equal words.

    A window is as long as the item if that is shorter than ``window`` (``same`` shrinks in
    proportion). Items of fewer than six words hold no seed and match nothing. NULL and empty texts
    match nothing; rows with a NULL id stay out; repeated rows give no second row. An empty table on
    either side gives an empty result. Extra columns are ignored.
    """
    docs = documents_of(docs)
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")
    ).select("item_id", hashes_of(F.col("text")).alias("hashes")).distinct()
    items = settled(items.where(F.size("hashes") > 0))
    seeds = settled(_seeds(items, "item_id").withColumnRenamed("at", "item_at"))
    known = seeds.select("seed").distinct()
    if known.count() <= BROADCAST_SEEDS:
        known = F.broadcast(known)
    spans = _seeds(docs.select("doc_id", hashes_of(F.col("text")).alias("hashes")), "doc_id")
    hits = settled(spans.join(known, "seed", "left_semi"))
    tries = settled(
        hits.join(seeds, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    )
    hit_docs = tries.select("doc_id").distinct()
    if hit_docs.count() <= BROADCAST_DOCS:
        hit_docs = F.broadcast(hit_docs)
    texts = docs.join(hit_docs, "doc_id", "left_semi").select("doc_id", hashes_of(F.col("text")).alias("words"))
    pairs = tries.join(texts, "doc_id").join(items, "item_id")

    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("hashes"), F.size("words") - F.col("shift"))
    aligned = pairs.withColumns({"low": low, "n": high - low}).where("n > 0").select(
        "doc_id", "item_id", (F.col("low") + F.col("shift")).alias("doc_low"), "n",
        F.least(F.lit(window), F.size("hashes")).alias("wide"),
        F.zip_with(
            F.slice("words", F.col("low") + F.col("shift") + 1, F.col("n")),
            F.slice("hashes", F.col("low") + 1, F.col("n")),
            lambda a, b: (a == b).cast("int"),
        ).alias("equal"),
    ).where("n >= wide")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    passing = F.filter(
        F.sequence(F.lit(0), F.col("n") - F.col("wide")),
        lambda i: total(F.slice("equal", i + 1, F.col("wide"))) * window >= F.col("wide") * same,
    )
    found = aligned.withColumn("passing", passing).where(F.size("passing") > 0)
    first, stop = F.element_at("passing", 1), F.element_at("passing", -1) + F.col("wide")
    spans = found.select(
        "doc_id", "item_id", (F.col("doc_low") + first).cast("long").alias("start"),
        (F.col("doc_low") + stop).cast("long").alias("stop"), (stop - first).cast("long").alias("n_words"),
        total(F.slice("equal", first + 1, stop - first)).cast("long").alias("n_equal"),
    )
    best = F.struct("n_equal", -F.col("n_words"), -F.col("start"), F.struct("start", "stop", "n_words", "n_equal").alias("b"))
    return spans.groupBy("doc_id", "item_id").agg(F.max(best)["b"].alias("b")).select("doc_id", "item_id", "b.*")

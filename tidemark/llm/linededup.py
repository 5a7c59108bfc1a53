"""Repeated lines: two Bloom filters find suspects, only those are shuffled and confirmed.

1. Each partition puts the hashes of its lines in a filter for seen once and, when they are there
   already, in a filter for seen twice. Partial filters travel as compressed slices and merge by
   bits: seen twice in a part, or seen once in two parts, is seen twice.
2. The filter for seen twice, of at most ``MAX_BITS``, goes to all tasks. A line that it does not
   hold occurs in one document, so it is neither shuffled nor looked at again. With more lines than
   the filter has room for it fills up and passes more suspects: results stay exact.
3. Suspects are counted by the SHA-256 of their key; the last document of a dropped key keeps it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import documents_of, forget, settled

BLANKS = textvec.BLANKS.decode()
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PROBES, BITS_A_LINE, MIN_BITS, MAX_BITS = 4, 16, 1 << 16, 1 << 28
SLICE = 1 << 13  # words of 64 bits, 64 KB
FILTERS = "slice int, part int, once binary, twice binary"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row per probe."""
    h = textvec.mix(hashes.astype(np.int64).view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (h + k * step) & np.uint64(bits - 1)


def _holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    hit = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
    return hit.all(axis=0)


def _put(words: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))


def twice_seen(lines: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of hashes seen twice, as 64-bit words. ``lines``: hashes array<long>."""
    words = bits // 64

    def partial(batches: Iterator[pa.RecordBatch]):
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        some = False
        forget()
        with np.errstate(over="ignore"):
            for batch in batches:
                got, n = np.unique(batch.column("hashes").flatten().to_numpy(), return_counts=True)
                if len(got):
                    some, at = True, _probes(got, bits)
                    _put(twice, at[:, (n > 1) | _holds(once, at)])
                    _put(once, at)
        for k in range(0, words, SLICE) if some else ():
            a, b = once[k : k + SLICE], twice[k : k + SLICE]
            if a.any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "slice": pa.array([k // SLICE], pa.int32()),
                        "part": pa.array([hash(int(a[a != 0][0])) % 64], pa.int32()),
                        "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(b.tobytes(), 1)],
                    }
                )

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.zeros(0, np.uint64)
        for a, b in zip(rows["once"], rows["twice"]):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (a, b))
            once, twice = (once | a, twice | b | (once & a)) if len(once) else (a, b)
        one = rows.iloc[:1].copy()
        one["once"], one["twice"] = zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)
        return one

    parts = lines.mapInArrow(partial, FILTERS)
    # Two steps, so one task never merges the slices of all partitions.
    parts = parts.groupBy("slice", "part").applyInPandas(merged, FILTERS)
    parts = parts.groupBy("slice").applyInPandas(merged, FILTERS).select("slice", "twice")
    out = np.zeros(words, np.uint64)
    for row in parts.toLocalIterator():  # at most MAX_BITS in all
        piece = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint64)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(piece)] = piece
    return out


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, ``carry``, ``text`` without repeated lines, ``n_lines`` and ``n_dropped``.

    Lines end at \\n; a line's key has the blanks at both ends stripped and A-Z folded. Keys of at
    least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their
    lines except in the largest doc_id that holds them. ``n_lines`` counts before dropping.

    A NULL or empty text is one empty line. Rows with a NULL doc_id stay out; rows that repeat a
    doc_id each give a row and count as one document. A text whose lines all go becomes empty.
    Columns other than ``carry`` are ignored; an empty table gives an empty result.
    """
    docs = documents_of(docs, *carry)
    keys = F.filter(
        F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars
    )
    keyed = docs.select("doc_id", F.array_distinct(keys).alias("keys"))
    hashed = F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes")
    lines = settled(keyed.select(hashed).where("size(hashes) > 0"))
    count = lines.agg(F.sum(F.size("hashes"))).first()[0] or 0
    bits = min(max(MIN_BITS, 1 << (BITS_A_LINE * count).bit_length()), MAX_BITS)
    seen = docs.sparkSession.sparkContext.broadcast(twice_seen(lines, bits))

    @F.pandas_udf("array<boolean>")
    def suspected(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]) if sizes.sum() else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            hit = _holds(seen.value, _probes(flat, bits))
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]))

    flagged = keyed.withColumn("flags", suspected(F.transform("keys", lambda k: F.xxhash64(k))))
    suspects = flagged.select(
        "doc_id", F.explode(F.filter("keys", lambda k, i: F.col("flags")[i])).alias("key")
    ).select("doc_id", F.sha2("key", 256).alias("key"))
    suspects = settled(suspects)
    found = suspects.distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")
    ).where(F.col("n") >= min_docs).drop("n")
    found = settled(found)  # as a table of its own, so that Spark can split a hot key's join
    drops = suspects.join(found, "key").where("doc_id != keeper").groupBy("doc_id").agg(
        F.collect_set("key").alias("drop")
    )
    whole = lines_of(F.col("text"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < min_chars) | ~F.array_contains("drop", F.sha2(key, 256))

    kept = F.when(F.col("drop").isNull(), whole).otherwise(F.filter(whole, stays))
    named = [F.col(f"`{c}`") for c in carry]
    return docs.join(drops, "doc_id", "left").withColumn("n_lines", F.size(whole).cast("long")).withColumn(
        "kept_lines", kept
    ).select(
        "doc_id", *named, F.array_join("kept_lines", "\n").alias("text"), "n_lines",
        (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"),
    )

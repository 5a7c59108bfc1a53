"""Context-triggered piecewise hashing: fingerprints that survive local edits.

A hash of the last ``REACH`` bytes ends a piece wherever its low ``level`` bits are all ones, so
borders move with the text and pieces are about 2**level bytes (the block size). Each piece gives
one of 64 characters by a hash of its bytes. The level is the least of at least ``LOWEST`` with fewer
than ``LONGEST`` borders; a second signature one level higher makes neighbouring block sizes
comparable. Signatures are compared by edit distance (insert and delete 1, replace 2), and count as
unrelated without a common run of ``RUN`` characters.

Whole batches of texts are hashed as one array of bytes, and compared as one array of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import documents_of
from tidemark.llm.ordered import in_parts

REACH, LOWEST, LONGEST, RUN = 7, 2, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CHUNK_BYTES, CHUNK_PAIRS = 1 << 20, 256
NEXT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def fingerprint(texts: list[bytes]) -> list[str]:
    """``level:signature:signature`` of each text, the second of block size twice as large."""
    out: list[str] = []
    chunk, held = [], 0
    for text in texts:
        chunk.append(text)
        held += len(text)
        if held >= CHUNK_BYTES:
            out += _fingerprints(chunk)
            chunk, held = [], 0
    return out + (_fingerprints(chunk) if chunk else [])


def _fingerprints(texts: list[bytes]) -> list[str]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, count = len(data), len(texts)
    base = np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    values = (textvec.seeds(256, 23) >> np.uint64(32)).astype(np.uint32)[data]
    rolling = np.zeros(n, np.uint32)
    step = np.uint32(1)
    for back in range(REACH):
        part = values[: max(n - back, 0)] * step
        for edge in base[1:-1]:  # the window does not reach into the text before
            part[max(edge - back, 0) : edge] = 0
        rolling[back:] += part
        step = step * np.uint32(0x01000193)
    rolling = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    rolling ^= rolling >> np.uint32(13)
    low = np.uint32((1 << LOWEST) - 1)
    at = np.flatnonzero((rolling & low) == low)
    level = np.bitwise_count(rolling[at] ^ (rolling[at] + np.uint32(1))).astype(np.int64) - 1
    level[rolling[at] == np.uint32(0xFFFFFFFF)] = 32
    doc = np.searchsorted(base, at, "right") - 1
    per_level = np.bincount(doc * 33 + level, minlength=count * 33).reshape(count, 33)
    at_least = per_level[:, ::-1].cumsum(axis=1)[:, ::-1]
    chosen = np.argmax((at_least < LONGEST) & (np.arange(33) >= LOWEST), axis=1)

    up = np.full(n + 1, np.uint64(textvec._STEP))
    up[0] = 1
    up = np.cumprod(up)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.seeds(256, 29)[data] * up[:n])])
    signatures = []
    for extra in (0, 1):
        border = level >= chosen[doc] + extra
        # Each piece ends after a border byte, or at the text's end if bytes are left there.
        ends = np.unique(np.concatenate([at[border] + 1, base[1:]]))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        # Equal bytes give equal values wherever they stand: divide by the power at the start.
        piece = textvec.mix((total[ends] - total[starts]) * _inverse(starts))
        chars = ALPHABET[(piece >> np.uint64(58)).astype(np.int64)]
        owner = np.searchsorted(starts, base)
        signatures.append([chars[owner[k] : owner[k + 1]].tobytes().decode() for k in range(count)])
    return [f"{c}:{a}:{b}" for c, a, b in zip(chosen.tolist(), *signatures)]


def _inverse(power: np.ndarray) -> np.ndarray:
    """The step's inverse to each power, by squaring."""
    out, square, rest = np.ones(len(power), np.uint64), textvec._BACK, power.copy()
    while rest.any():
        out = np.where(rest & 1, out * np.uint64(square), out)
        square, rest = square * square % (1 << 64), rest >> 1
    return out


def _rows(signatures: list[str], filler: int) -> np.ndarray:
    joined = "".join(s.ljust(LONGEST, chr(filler)) for s in signatures)
    return np.frombuffer(joined.encode(), np.uint8).reshape(-1, LONGEST)


def _alike(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance / total length, per pair of signatures of at most 64 characters."""
    out = np.zeros(len(left))
    for k in range(0, len(left), CHUNK_PAIRS):
        a, b = left[k : k + CHUNK_PAIRS], right[k : k + CHUNK_PAIRS]
        na, nb = np.array(list(map(len, a))), np.array(list(map(len, b)))
        same = _rows(a, 1)[:, :, None] == _rows(b, 2)[:, None, :]
        masks = np.packbits(same, axis=1, bitorder="little").transpose(0, 2, 1).copy().view(np.uint64)[:, :, 0]
        free = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(LONGEST):  # the longest common subsequence, all of a row's bits at once
            hit = free & masks[:, j]
            free = (free + hit) | (free - hit)
        common = np.bitwise_count(~free).astype(np.float64)
        run = same[:, :-1, :-1] & same[:, 1:, 1:]
        run = run[:, :-2, :-2] & run[:, 2:, 2:]
        run = run[:, :-3, :-3] & run[:, 3:, 3:]
        related = run.any(axis=(1, 2)) | (np.minimum(na, nb) < RUN)
        out[k : k + len(a)] = np.where(related, 2 * common / np.maximum(na + nb, 1), 0.0)
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints; 1 if equal, 0 if block sizes are not compatible."""
    pairs: list[tuple[int, str, str]] = []
    out = np.zeros(len(left))
    for k, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[k] = 1.0
            continue
        (lx, x1, x2), (ly, y1, y2) = x.split(":"), y.split(":")
        gap = int(lx) - int(ly)
        pairs += [(k, x1, y1), (k, x2, y2)] if gap == 0 else [(k, x1, y2)] if gap == 1 else [(k, x2, y1)] if gap == -1 else []
    if pairs:
        np.maximum.at(out, [p[0] for p in pairs], _alike([p[1] for p in pairs], [p[2] for p in pairs]))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each whole text; a NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            with np.errstate(over="ignore"):
                made = fingerprint([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "fingerprint"])

    return documents_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


def near(left: Column, right: Column) -> Column:
    """Likeness of two fingerprint columns; NULL if one is NULL."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = a.notna() & b.notna()
        out = pd.Series(np.nan, index=a.index)
        with np.errstate(over="ignore"):
            out[both] = likeness(a[both].tolist(), b[both].tolist())
        return out.astype(object).where(both, None)

    return run(left, right)


def edited_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The next document is the one of the next lower doc_id, the largest one after the smallest. The
    edited text has the last third (rounded down, in code points) replaced by as many of the next
    document's first code points, or all it has.

    A NULL text counts as empty. Rows with a NULL doc_id stay out; rows that repeat a doc_id follow
    one another in the order of a hash of their text. A single document is its own next one. Extra
    columns are ignored; an empty table gives an empty result.
    """
    docs, parts = in_parts(documents_of(docs), descending=True)
    docs = docs.withColumn("border", F.lit(False))
    # The first document of a part is also the next one of the last document of the part before.
    if parts:
        numbers = [p for p, _ in parts]
        before = dict(zip(numbers, [numbers[-1], *numbers[:-1]]))
        firsts = docs.sparkSession.createDataFrame(
            [(first, before[p]) for p, first in parts], "doc_id long, part int"
        )
        copies = docs.drop("part").join(F.broadcast(firsts), "doc_id").withColumn("border", F.lit(True))
        docs = docs.unionByName(copies)
    docs = docs.repartitionById(max(1, len(parts)), "part").sortWithinPartitions(
        "part", "border", F.desc("doc_id"), F.xxhash64("text")
    )

    def run(batches: Iterator[pa.RecordBatch]):
        held = None  # the row before, which waits for its next one
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "border")]))
            with np.errstate(over="ignore"):
                prints = fingerprint([r[1].encode() for r in rows])
            rows = [(*r, f) for r, f in zip(rows, prints)]
            rows = [held, *rows] if held else rows
            held = rows[-1]
            # Of the border's rows only the first is anyone's next one.
            yield _compared([(x, y) for x, y in zip(rows, rows[1:]) if not x[3] and x[2] == y[2]])

    return docs.mapInArrow(run, NEXT)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    edited = []
    for x, y in pairs:
        third = len(x[1]) // 3
        edited.append((x[1][: len(x[1]) - third] + y[1][:third]).encode())
    own = [x[4] for x, _ in pairs]
    with np.errstate(over="ignore"):
        after = fingerprint(edited)
        near_edited, near_next = likeness(own, after), likeness(own, [y[4] for _, y in pairs])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x, _ in pairs], pa.int64()), pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(own, pa.string()),
            pa.array(after, pa.string()), pa.array(near_edited), pa.array(near_next),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )

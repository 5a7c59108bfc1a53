"""Whole Arrow columns of text as arrays: word borders and 64-bit word hashes without strings.

Works on the UTF-8 bytes. Blank bytes are ASCII, so a border is always one between characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLANKS = b" \t\n\x0b\x0c\r"
_STEP, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 18
_STEP = _STEP if _STEP % 8 in (3, 5) else _STEP ^ 6  # a step of full order modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a bijection)."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


class Words(NamedTuple):
    """Words of some documents: bytes ``start`` to ``end`` (of ``data``), hash, document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per document its first word; one entry more than documents
    rows: slice  # documents of the column these are
    base: np.ndarray  # per document its first byte; one entry more than documents


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a text column without NULLs."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, borders, data = column.buffers()
    if borders is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, at.astype(np.int64)


def words(column: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Words (runs of non-blank bytes), in blocks of documents of about 256 KB.

    ``lower`` folds A-Z. Equal words get equal hashes in every process.
    """
    table = seeds(256, 7)
    if lower:
        table[65:91] = table[97:123]
    solid = np.ones(256, bool)
    solid[list(BLANKS)] = False
    raw, at = utf8(column)
    size = max(_CHUNK, int(np.diff(at).max(initial=0))) + 1
    up = np.full(size, U64(_STEP))
    back = np.full(size, U64(_BACK))
    up[0] = back[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(back, out=back)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + _CHUNK, "right")) - 1)
        data, base = raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        yield _block(data, base, slice(row, stop), table, solid, up, back)
        row = stop


_powers: list[np.ndarray] = []  # of the step and its inverse, as far as needed so far


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes; equal runs get equal hashes in every process."""
    n = len(data)
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        _powers[:] = [np.full(size, U64(x)) for x in (_STEP, _BACK)]
        for p in _powers:
            p[0] = 1
            np.cumprod(p, out=p)
    up, back = _powers
    total = np.zeros(n + 1, U64)
    np.cumsum(seeds(256, 7)[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + U64(0x51ED27))


def _block(data, base, rows, table, solid, up, back) -> Words:
    inside = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[base] = True
    borders = np.flatnonzero(edge)
    keep = inside[borders[:-1]] if len(data) else np.zeros(0, bool)
    start, end = borders[:-1][keep], borders[1:][keep]
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * back[start] + U64(0x51ED27))
    return Words(data, start, end, h, np.searchsorted(start, base), rows, base)


def shingles(w: Words, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, and each document's first (one entry more).

    With ``short``, a document of fewer words (but some) has its whole sequence as one run.
    """
    count = np.diff(w.first)
    runs = np.maximum(count - size + 1, ((count > 0) & short).astype(count.dtype))
    first = np.concatenate([[0], np.cumsum(runs)])
    doc = np.repeat(np.arange(len(count)), runs)
    start = w.first[:-1][doc] + np.arange(first[-1]) - first[:-1][doc]
    have = np.minimum(count[doc], size)
    out = have.astype(U64)
    padded = np.concatenate([w.hash, np.zeros(size, U64)])
    for k in range(size):
        out = np.where(k < have, mix(out * U64(0x2545F4914F6CDD1D) + padded[start + k]), out)
    return out, first

"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of some documents, in order (all numbers little-endian):

    magic "PFR1", documents u64, ids u64, blocks u64
    doc_id i64 and count u64 of each document
    start of each block in the file u64, and the end of the last
    blocks of ``BLOCK`` ids (the last has the rest): least id u32, ids u16, exceptions u16, width u8,
    the low ``width`` bits of the differences to the least id (32 values in ``width`` words of 32
    bits, the last group filled up), places u16 and differences u32 of those that need more bits

A block's width holds its ``PERCENTILE`` smallest differences, so a few large ids do not widen the
others. The index of block starts gives any range of ids without reading the rest.

Documents are cut into ranges of doc_id; each range is sorted and streamed into files of at most
``FILE_IDS`` ids by one task. A task attempt writes under a name of its own and reports it as a row;
only reported files are read, so an attempt that was lost or run twice leaves no trace in the result.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, per_worker, settled
from tidemark.llm.ordered import in_parts

MAGIC, BLOCK, PERCENTILE, FILE_IDS = b"PFR1", 1024, 95, 8 << 20
CACHE_WORDS, SEEN_SLOTS = 450_000, 1 << 24
FILES = "part int, piece int, path string, n_docs long, n_ids long"
IDS = "doc_id long, start long, n_tokens long, ids binary"
_HEAD = np.dtype([("least", "<u4"), ("ids", "<u2"), ("odd", "<u2"), ("width", "u1")])

# How a byte-level tokenizer splits text (the public pattern, for these letters alone).
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)
PLAIN = re.compile(rf"[!-~\n\t {_LETTERS}]*")
# A blank before a visible character always starts a new word there.
WORDS = re.compile(" (?=[!-~¡-ɏ])")


class Encoder:
    """Ids of whole texts by a tokenizers file.

    A byte-level tokenizer with the usual split treats words alone. Words (with the blank before
    them) and their parts that come a second time are kept, up to ``CACHE_WORDS`` of each, so common
    ones are merged once per worker. Words of other scripts or with special tokens, and all texts of
    other tokenizers, take the library's plain way.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        config = json.loads(tokenizer)
        split = config.get("pre_tokenizer") or {}
        self.by_word = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and not config.get("normalizer")
        )
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        # No special token may hide in a word of letters with a stop or a comma.
        self.by_word &= not any(t.strip(".,").isalpha() for t in self.special)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + k for k, b in enumerate(hidden)}  # bytes that are written otherwise
        self.blank, self.merge = chr(self.letters[32]), self.tokenizer.model.tokenize
        self.known = _Known(self.after_blank)
        self.parts = _Known(self.part)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        if not self.by_word:
            return [self.plain(t) for t in texts]
        out = []
        for text in texts:
            first, *rest = WORDS.split(text)
            out.append(self.word(first) + b"".join(map(self.known.__getitem__, rest)))
        return out

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def after_blank(self, word: str) -> bytes:
        """Most words are letters, with a stop or a comma at most: known to split there."""
        stem = word[:-1] if word[-1:] in (".", ",") else word
        if stem.isalpha() and max(stem) < "ɐ":
            ids = self.parts[" " + stem]
            return ids if stem is word else ids + self.parts[word[-1]]
        return self.word(" " + word)

    def word(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(t in text for t in self.special):
            return self.plain(text)
        return b"".join(map(self.parts.__getitem__, SPLIT.findall(text)))

    def part(self, text: str) -> bytes:
        if text.isascii() and text[1:].isalpha():
            shown = text.replace(" ", self.blank)
        else:
            shown = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(shown)]).tobytes()


class _Known(dict):
    """Values of ``make``, kept from the second time on that a key comes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.seen = make, bytearray(SEEN_SLOTS)

    def __missing__(self, key: str) -> bytes:
        value, slot = self.make(key), hash(key) % SEEN_SLOTS
        if self.seen[slot] and len(self) < CACHE_WORDS:
            self[key] = value
        self.seen[slot] = 1
        return value


def pack(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids``, all full blocks at once."""
    full = len(ids) // BLOCK * BLOCK
    blocks = _packed(ids[:full].reshape(-1, BLOCK)) if full else []
    return blocks + (_packed(ids[full:].reshape(1, -1)) if full < len(ids) else [])


def _packed(rows: np.ndarray) -> list[bytes]:
    rows = rows.astype(np.uint32)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    rank = (rows.shape[1] * PERCENTILE + 99) // 100 - 1
    widths = np.frexp(np.partition(rows, rank, axis=1)[:, rank].astype(np.float64))[1]
    out: list[bytes] = [b""] * len(rows)
    for width in map(int, np.unique(widths)):
        at = np.flatnonzero(widths == width)
        some = rows[at]
        odd = (some >> np.uint32(width) if width < 32 else np.zeros_like(some)) != 0
        packed = _squeezed(some, width).view(np.uint8)
        for k, i in enumerate(at):
            places = np.flatnonzero(odd[k])
            head = np.array((least[i], rows.shape[1], len(places), width), _HEAD)
            out[i] = b"".join(
                [head.tobytes(), packed[k].tobytes(), places.astype("<u2").tobytes(), some[k, places].astype("<u4").tobytes()]
            )
    return out


def _squeezed(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value: 32 values in ``width`` words, per row."""
    groups = -(-rows.shape[1] // 32)
    lanes = np.zeros((32, len(rows), groups), np.uint64)
    padded = np.zeros((len(rows), groups * 32), np.uint64)
    padded[:, : rows.shape[1]] = rows & np.uint32((1 << width) - 1)
    lanes[:] = padded.reshape(len(rows), groups, 32).transpose(2, 0, 1)
    words = np.zeros((width + 1, len(rows), groups), np.uint64)
    for lane in range(32):
        word, shift = divmod(lane * width, 32)
        part = lanes[lane] << np.uint64(shift)
        words[word] |= part & np.uint64(0xFFFFFFFF)
        words[word + 1 if width else 0] |= part >> np.uint64(32)
    return np.ascontiguousarray(words[:width].transpose(1, 2, 0).astype("<u4")).reshape(len(rows), groups * width)


def _spread(words: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``_squeezed``: rows of whole groups of 32 values."""
    n = words.shape[0]
    if not width:
        return np.zeros((n, BLOCK), np.uint32)
    groups = words.shape[1] // width
    by_word = np.zeros((width + 1, n, groups), np.uint64)
    by_word[:width] = words.reshape(n, groups, width).transpose(2, 0, 1)
    lanes = np.empty((32, n, groups), np.uint32)
    for lane in range(32):
        word, shift = divmod(lane * width, 32)
        part = (by_word[word] | (by_word[word + 1] << np.uint64(32))) >> np.uint64(shift)
        lanes[lane] = part & np.uint64((1 << width) - 1)
    return lanes.transpose(1, 2, 0).reshape(n, groups * 32)


def unpack(blocks: list[bytes]) -> np.ndarray:
    """Ids of consecutive blocks; blocks of one width and length at once."""
    heads = [np.frombuffer(b, _HEAD, 1)[0] for b in blocks]
    alike: dict[tuple[int, int], list[int]] = {}
    for k, head in enumerate(heads):
        alike.setdefault((int(head["width"]), int(head["ids"])), []).append(k)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for (width, n), at in alike.items():
        size = 4 * width * -(-n // 32)
        words = np.frombuffer(b"".join(blocks[k][_HEAD.itemsize : _HEAD.itemsize + size] for k in at), "<u4")
        rows = _spread(words.reshape(len(at), -1), width)[:, :n]
        for k, ids in zip(at, rows):
            odd, after = int(heads[k]["odd"]), _HEAD.itemsize + size
            if odd:
                ids[np.frombuffer(blocks[k], "<u2", odd, after)] = np.frombuffer(blocks[k], "<u4", odd, after + 2 * odd)
            out[k] = ids + heads[k]["least"]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def file_bytes(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    blocks = pack(ids)
    head = MAGIC + np.array([len(doc_ids), len(ids), len(blocks)], "<u8").tobytes()
    docs = np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u8").tobytes()
    begin = len(head) + len(docs) + 8 * (len(blocks) + 1)
    index = begin + np.concatenate([[0], np.cumsum(list(map(len, blocks)))])
    return b"".join([head, docs, index.astype("<u8").tobytes(), *blocks])


class Header(NamedTuple):
    doc_ids: np.ndarray
    counts: np.ndarray
    index: np.ndarray
    n_ids: int


def read_header(f) -> Header:
    magic = f.read(28)
    if magic[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, ids, blocks = (int(x) for x in np.frombuffer(magic, "<u8", 3, 4))
    return Header(
        np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64),
        np.frombuffer(f.read(8 * (blocks + 1)), "<u8").astype(np.int64), ids,
    )


def read_range(f, head: Header, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of an open file, from the blocks that hold them alone."""
    first, last = start // BLOCK, min(-(-stop // BLOCK), len(head.index) - 1)
    if stop <= start or first >= last:
        return np.zeros(0, np.uint32)
    f.seek(int(head.index[first]))
    raw = f.read(int(head.index[last] - head.index[first]))
    at = head.index[first : last + 1] - head.index[first]
    ids = unpack([raw[a:b] for a, b in zip(at, at[1:])])
    return ids[start - first * BLOCK : stop - first * BLOCK]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write the ids of all documents, in order of doc_id, and return the files: one row each.

    ``tokenizer`` is the path of a tokenizers file, read on the driver; special tokens are not added,
    but ``end_id`` follows each document. ``folder`` is a place that all executors can write to.

    A NULL or empty text is the end id alone. Rows with a NULL doc_id stay out; rows that repeat a
    doc_id follow one another in the order of a hash of their text. Extra columns are ignored; an
    empty table gives no files.
    """
    model = open(tokenizer, encoding="utf-8").read()
    docs, parts = in_parts(documents_of(docs))
    docs = docs.repartitionById(max(1, len(parts)), "part").sortWithinPartitions("part", "doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def save(part: int, piece: int, rows: list[tuple[int, bytes]]) -> dict:
        store, path = fs.FileSystem.from_uri(folder) if "://" in folder or ":" in folder[:6] else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        name = f"part-{part:06d}-{piece:04d}-{uuid.uuid4().hex}.pfr"
        ids = np.frombuffer(b"".join(r[1] for r in rows), "<u4")
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(file_bytes([r[0] for r in rows], [len(r[1]) // 4 for r in rows], ids))
        return {"part": part, "piece": piece, "path": f"{folder}/{name}", "n_docs": len(rows), "n_ids": len(ids)}

    def run(batches: Iterator[pa.RecordBatch]):
        encode = per_worker(("encoder", hash(model)), lambda: Encoder(model))
        part, piece, held, size = None, 0, [], 0

        def saved():
            return pa.RecordBatch.from_pylist([save(part, piece, held)], FILE_TYPE)

        for batch in batches:
            made = encode(batch.column("text").to_pylist())
            for doc_id, p, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), made):
                if held and (p != part or size > FILE_IDS):
                    yield saved()
                    piece, held, size = (piece + 1 if p == part else 0), [], 0
                part = p
                held.append((doc_id, ids + end))
                size += len(ids) // 4 + 1
        if held:
            yield saved()

    return settled(docs.mapInArrow(run, FILES))


FILE_TYPE = pa.schema(
    [("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
)


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids`` (LE u32) again."""
    order = Window.partitionBy("part").orderBy("piece")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # at most MOST_PARTS rows
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(parts), "part").withColumn(
        "start", F.col("base") + F.sum("n_ids").over(order) - F.col("n_ids")
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                uri = "://" in path or ":" in path[:6]
                store, place = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
                with store.open_input_file(place) as f:
                    head = read_header(f)
                    ends = np.cumsum(head.counts)
                    at = 0
                    while at < len(ends):  # about a million ids at a time
                        low = int(ends[at - 1]) if at else 0
                        upto = max(at + 1, int(np.searchsorted(ends, low + (1 << 20))))
                        ids = read_range(f, head, low, int(ends[upto - 1]))
                        cut = np.concatenate([[0], ends[at:upto] - low])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(head.doc_ids[at:upto]), pa.array(start + low + cut[:-1]),
                                pa.array(head.counts[at:upto]),
                                pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = upto

    many = files.sparkSession.sparkContext.defaultParallelism * 4
    return placed.select("path", "start").repartition(many, "path").mapInArrow(run, IDS)

"""Sampled segmentations of whole texts into pieces, without replacement, and decoding.

A segmentation's log probability is the sum of its pieces' weights, normalised over the lattice of
all segmentations. Weights follow Zipf's law on a piece's rank in the vocabulary, as merge tables
give ranks and no probabilities. The lattice falls apart at borders that no piece crosses, so it is
built per distinct unit (a word with the blanks before it), and common ones stay in a worker's cache.

Search: a node is a prefix of pieces; its bound, the perturbed log mass of all completions, is exact
because the backward sums of the lattice are. The best-first search therefore goes straight down to
the segmentation of the largest perturbed value, which is a plain sample, leaving at each piece one
open node for "the prefix, but another piece here", whose bound is a Gumbel value cut at the parent's.
The next segmentation starts at the open node of the largest bound, and so on: the ``samples``
segmentations of largest perturbed value, in order (Gumbel top-k without replacement). All documents
of a batch go down together in arrays. Open nodes whose mass is below double precision stay out.

With kappa the bound of the best node left, ``inclusion`` = 1 - exp(-exp(log_prob - kappa)) is the
chance that a segmentation is among those above kappa; 1 / inclusion weights unbiased sums.
Random values are a function of the seed, the doc_id and the position alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import textvec
from tidemark.llm.common import documents_of, per_worker
from tidemark.llm.textvec import U64, mix

SPACE = "▁"  # fixed value: how the vocabulary writes a blank
CACHE_NODES = 700_000  # nodes that a worker keeps, about 70 MB
NEAR = 1 << 19
SEEN_SLOTS, ADD = 1 << 22, 8192  # units whose lattices are built together
LEAST_MASS = -60.0
SAMPLES = (
    "doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double,"
    " inclusion double, round_trip boolean"
)


class Vocabulary(NamedTuple):
    text: list[str]  # of each id; "" for control pieces
    byte_ids: np.ndarray  # 256 ids of single bytes
    weight: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a SentencePiece model file (read on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text, byte_ids = [""] * n, np.zeros(256, np.int64)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            text[i] = piece
    first = next((i for i, t in enumerate(text) if t), 0)
    rank = np.maximum(np.arange(n) - first, 0)
    if any(re.search(f"[^{SPACE}]{SPACE}|.\\n|\\n.", t) for t in text):
        raise ValueError("a piece crosses the border of a unit")
    return Vocabulary(text, byte_ids, -np.log(2.0 + rank))


class Units(NamedTuple):
    """Units of some texts: a line break, or blanks with the word after them; ``first`` per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one entry more than texts

    def texts(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes() if len(which) > 64 else None
        spans = zip(self.start[which].tolist(), self.end[which].tolist())
        if raw is None:
            return [self.data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in spans]
        return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in spans]


def split_units(texts: list[str]) -> Units:
    """A blank is put before every text that is not empty."""
    raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    base = np.concatenate([[0], np.cumsum(list(map(len, raw)), dtype=np.int64)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    blank, line = data == 32, data == 10
    begin = line.copy()
    begin[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    begin[base[:-1][np.diff(base) > 0]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(data)) if len(start) else start
    return Units(data, start, end, textvec.run_hashes(data, start, end), np.searchsorted(start, base))


class Lattices:
    """Edges of the lattices of all units seen, node by node.

    Node 0 ends every unit. Edge arrays: next node, id (or -1 - a code point that is
    written as bytes), its node, conditional log probability, that of the node's other edges, and the running
    sum of probabilities within the node.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary.text))
        begun: list[dict[str, int]] = [{} for _ in range(self.longest)]
        for i, text in enumerate(t.replace(SPACE, " ") for t in vocabulary.text):
            for k in range(len(text)):
                begun[k].setdefault(text[: k + 1], -1)
            if text:
                begun[len(text) - 1][text] = i
        self.keys = []  # per length the hashes of beginnings of pieces, and the piece's id or -1
        for k, known in enumerate(begun):
            joined = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32).reshape(-1, k + 1)
            key = np.zeros(len(known), U64)
            for c in range(k + 1):
                key = mix(key + joined[:, c].astype(U64))
            order = np.argsort(key)
            held = np.zeros(NEAR, bool)  # by low bits: turns most other keys away before the search
            held[(key & U64(NEAR - 1)).astype(np.int64)] = True
            self.keys.append((key[order], np.array(list(known.values()), np.int64)[order], held))
        self.clear()

    def clear(self) -> None:
        self.room: dict[str, np.ndarray] = {}
        self.start: dict[int, int] = {}  # by hash
        self.first = np.zeros(2, np.int64)  # per node; one entry more than nodes
        self.next, self.id, self.source = (np.zeros(0, np.int32) for _ in range(3))
        self.log, self.sum = np.zeros(0), np.zeros(0)
        self.seen = np.zeros(SEEN_SLOTS, bool)  # units that came once, by hash
        self.once = np.zeros(0, U64)
        self.kept = 1, 0  # nodes (with the end) and edges that stay

    def nodes_of(self, units: Units) -> np.ndarray:
        """First node of every unit. Units are told apart by their 64-bit hashes."""
        nodes, edges = self.kept
        self.first = self.first[: nodes + 1]
        for name in ("next", "id", "source", "log", "sum"):
            setattr(self, name, getattr(self, name)[:edges])
        mask = U64(SEEN_SLOTS - 1)
        self.seen[self.once & mask] = True
        different, at, inverse = np.unique(units.hash, return_index=True, return_inverse=True)
        keys = different.tolist()
        known = np.fromiter(map(self.start.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(known < 0)
        came = self.seen[different[missing] & mask] & (nodes < CACHE_NODES)

        def add(some: np.ndarray) -> None:
            for a in range(0, len(some), ADD):
                part = some[a : a + ADD]
                known[part] = self._add(units.texts(at[part]))

        again, once = missing[came], missing[~came]
        add(again)
        self.start.update(zip(different[again].tolist(), known[again].tolist()))
        self.kept = len(self.first) - 1, len(self.next)
        # Units that came once are known in this batch alone.
        self.once = different[once]
        add(once)
        return known[inverse]

    def _add(self, units: list[str]) -> np.ndarray:
        """Lattices of units; the first node of each."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array(list(map(len, units)), np.int64)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        left = np.repeat(borders[1:], sizes) - np.arange(len(points))  # characters to the unit's end
        source, size, ids = [], [], []
        at, key = np.arange(len(points)), np.zeros(len(points), U64)
        single = np.zeros(len(points), bool)
        for k, (known, known_ids, held) in enumerate(self.keys):
            live = left[at] > k
            at, key = at[live], key[live]
            if not len(at):
                break
            key = mix(key + points[at + k].astype(U64))
            near = held[(key & U64(NEAR - 1)).astype(np.int64)]
            at, key = at[near], key[near]
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[place] == key
            at, key, found = at[hit], key[hit], known_ids[place[hit]]
            whole = found >= 0  # others are only the beginning of a piece
            source.append(at[whole])
            size.append(np.full(whole.sum(), k + 1))
            ids.append(found[whole])
            if k == 0:
                single[at[whole]] = True
        lone = np.flatnonzero(~single)
        source, size = np.concatenate([*source, lone]), np.concatenate([*size, np.ones(len(lone), np.int64)])
        ids = np.concatenate([*ids, -1 - points[lone].astype(np.int64)])
        width = 1 + sum((ids < -size).astype(np.int64) for size in (0x80, 0x800, 0x10000))  # bytes of a code point
        weight = self.vocabulary.weight[np.maximum(ids, 0)]
        weight = np.where(ids < 0, width * -np.log(2.0 + len(self.vocabulary.text)), weight)

        # Node by node, long pieces first: mostly the likeliest.
        order = np.argsort(source * 32 - size, kind="stable")
        source, size, ids, weight = source[order], size[order], ids[order], weight[order]
        # Backward sums, all units at once, from their ends.
        beta = np.zeros(len(points) + 1)
        away = left[source]
        ends = away == size
        small = away.astype(np.int16) if len(away) and away.max() < 1 << 15 else away
        order = np.argsort(small, kind="stable")
        groups = np.flatnonzero(np.diff(away[order], prepend=-1))
        after = np.where(ends, len(points), source + size)
        for a, b in zip(groups, [*groups[1:], len(order)]):
            e = order[a:b]
            heads = np.flatnonzero(np.diff(source[e], prepend=-1))
            beta[source[e[heads]]] = np.logaddexp.reduceat(weight[e] + beta[after[e]], heads)
        log = weight + beta[after] - beta[source]

        offset = len(self.first) - 1
        heads = np.searchsorted(source, np.arange(len(points) + 1))
        running = np.cumsum(np.exp(log))
        running = running - np.concatenate([[0.0], running])[heads[:-1]][source]
        running[heads[1:] - 1] = np.inf
        for name, new in (
            ("first", len(self.next) + heads[1:]), ("next", np.where(ends, 0, offset + source + size)),
            ("id", ids), ("source", offset + source), ("log", log), ("sum", running),
        ):
            old = getattr(self, name)
            room, n = self.room.get(name), len(old) + len(new)
            if room is None or len(room) < n:  # room for a full cache, touched as it fills
                room = self.room[name] = np.empty(max(n + n // 2, 4 * CACHE_NODES), old.dtype)
                room[: len(old)] = old
            room[len(old) : n] = new
            setattr(self, name, room[:n])
        return offset + borders[:-1]

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled edge sequence from each node to its unit's end: edges, first of each node."""
        live, node, steps, k = np.arange(len(node)), node.copy(), [], 0
        count = np.zeros(len(node), np.int64)
        while len(live):
            u = (mix(key[live] + U64(k + 1) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            wait = np.flatnonzero(u >= self.sum[edge])
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] >= self.sum[edge[wait]]]
            steps.append((live, edge))
            count[live] = k = k + 1
            node = self.next[edge]
            go = node != 0
            live, node = live[go], node[go].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        edges = np.zeros(first[-1], np.int64)
        for k, (live, edge) in enumerate(steps):
            edges[first[live] + k] = edge
        return edges, first


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(mass, top, u):
    """Gumbel value of a node of log mass ``mass`` given that it is below ``top``."""
    return mass - np.log(np.exp(mass - top) - np.log(u))


class _Path(NamedTuple):
    edges: np.ndarray
    units: np.ndarray  # per edge the number of its unit in the document
    value: float
    log: float


def _sample_batch(lat: Lattices, texts: list[str], doc_keys: np.ndarray, samples: int) -> list[list[tuple]]:
    """Per document (edges, log probability, perturbed value, kappa) of its best segmentations."""
    units = split_units(texts)
    base, starts = units.first, lat.nodes_of(units)
    paths: list[list[_Path]] = [[] for _ in texts]
    heaps: list[list] = [[] for _ in texts]
    forced: list[tuple] = [(0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0)] * len(texts)
    roots = -np.log(-np.log(_uniform(doc_keys)))
    turn = np.arange(len(texts))
    for r in range(samples):
        # Documents of this round: units from the branch on are sampled anew.
        nodes, owner = [], []
        for d in turn:
            unit, node = forced[d][:2]
            own = starts[base[d] + unit : base[d + 1]]
            if r and node:
                own = np.concatenate([[node], own[1:]])
            elif r:
                unit, own = unit + 1, own[1:]
            nodes.append(own)
            owner.append(unit)
        sizes = np.array(list(map(len, nodes)), np.int64)
        spans = np.concatenate([[0], np.cumsum(sizes)])
        number = np.arange(spans[-1]) - np.repeat(spans[:-1] - np.array(owner, np.int64), sizes)
        keys = mix(np.repeat(mix(doc_keys[turn] + U64(r + 1)), sizes) + number.astype(U64) * U64(0xD1342543DE82EF95))
        edges, first = lat.walk(np.concatenate(nodes or [starts]), keys)
        cut = first[spans]
        logs = lat.log[edges]
        units_of = np.repeat(number, np.diff(first))
        for n, d in enumerate(turn):
            a, b = cut[n], cut[n + 1]
            _, _, kept_edges, kept_units, kept_log = forced[d]
            value = roots[d] if not r else forced_value[d]
            some = 256
            while True:  # most texts are too unlikely after a few pieces to open a node there
                before = kept_log + np.concatenate([[0.0], np.cumsum(logs[a : min(b, a + some)])])
                if before[-1] < LEAST_MASS or a + some >= b:
                    break
                some *= 4
            before = before[:-1]
            node = lat.source[edges[a : a + len(before)]]
            open_at = np.flatnonzero((lat.first[node + 1] - lat.first[node] > 1) & (before > LEAST_MASS))
            mass = before[open_at] + np.log1p(-np.minimum(np.exp(logs[a + open_at]), 1 - 1e-16))
            at = open_at + len(kept_edges)
            u = _uniform(doc_keys[d] * U64(31) + U64(r + 1) + mix(at.astype(U64)))
            bound = _below(mass, value, u)
            best = np.argsort(-bound, kind="stable")[: samples - r]
            rank = len(paths[d])
            for i in best:
                heapq.heappush(heaps[d], (-bound[i], rank, int(at[i]), mass[i], (int(edges[a + open_at[i]]),)))
            path = edges[a:b], units_of[a:b]
            if r:
                path = np.concatenate([kept_edges, path[0]]), np.concatenate([kept_units, path[1]])
            paths[d].append(_Path(*path, value, kept_log + float(logs[a:b].sum())))
        if r == samples - 1:
            break
        forced_value, again = {}, []
        for d in turn:
            if not heaps[d]:
                continue
            again.append(d)
            bound, number, at, mass, taken = heapq.heappop(heaps[d])
            path = paths[d][number]
            node = lat.source[path.edges[at]]
            options = np.arange(lat.first[node], lat.first[node + 1])
            share = np.exp(lat.log[options])
            share[np.array(taken) - options[0]] = 0.0
            u = _uniform(mix(doc_keys[d : d + 1] + U64(r + 1)) + U64(7 * at + 3))[0]
            edge = int(options[min(np.searchsorted(np.cumsum(share), u * share.sum(), "right"), len(options) - 1)])
            prefix = float(lat.log[path.edges[:at]].sum())
            left = share.sum() - float(np.exp(lat.log[edge]))
            if left > 1e-15 and len(taken) + 1 < len(options):
                lower = prefix + np.log(left)
                u = _uniform(mix(doc_keys[d : d + 1] + U64(r + 1)) + U64(7 * at + 5))[0]
                heapq.heappush(heaps[d], (-_below(lower, -bound, u), number, at, lower, (*taken, edge)))
            forced_value[d] = -bound
            kept = np.concatenate([path.edges[:at], [edge]])
            forced[d] = (
                int(path.units[at]), int(lat.next[edge]), kept, path.units[: at + 1], float(lat.log[kept].sum())
            )
        turn = np.array(again, np.int64)
        if not len(turn):
            break
    out = []
    for d in range(len(texts)):
        kappa = -heaps[d][0][0] if heaps[d] else -np.inf
        out.append([(p.edges, p.log, p.value, kappa) for p in paths[d]])
    return out


def ids_of(lat: Lattices, edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of sequences of ``counts`` edges, and their numbers of ids.

    A code point outside the vocabulary becomes the ids of its bytes.
    """
    ids = lat.id[edges]
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, counts
    points, which = np.unique(-1 - ids[odd], return_inverse=True)
    raw = [chr(p).encode("utf-8", "surrogatepass") for p in points.tolist()]
    width = np.array(list(map(len, raw)), np.int64)
    table = np.zeros((len(raw), 4), np.int32)
    for k, x in enumerate(raw):
        table[k, : len(x)] = lat.vocabulary.byte_ids[list(x)]
    size = np.ones(len(ids), np.int64)
    size[odd] = width[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(ids, size)
    for byte in range(4):
        long = width[which] > byte
        out[ends[odd[long]] + byte] = table[which[long], byte]
    return out, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class Decoder:
    """Text of id sequences: bytes of all pieces in one array, gathered for a whole batch."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [t.replace(SPACE, " ").encode() for t in vocabulary.text]
        for byte, i in enumerate(vocabulary.byte_ids):
            raw[i] = bytes([byte])
        self.at = np.concatenate([[0], np.cumsum(list(map(len, raw)))])
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each sequence of ``counts`` ids without the leading blank, and its borders."""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.data[take]
        borders = ends[np.concatenate([[0], np.cumsum(counts)])]
        blank = borders[:-1][counts > 0]
        keep = np.ones(len(data), bool)
        keep[blank] = data[blank] != 32
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[borders]


def sample_segmentations(docs: DataFrame, model: str, samples: int = 2, seed: int = 0) -> DataFrame:
    """``samples`` distinct segmentations of each whole text, by falling perturbed value.

    ``doc_id``, ``sample`` (from 1), ``ids``, ``n_pieces``, ``log_prob``, ``perturbed``,
    ``inclusion`` and ``round_trip`` (the ids decode to the text). A text with fewer segmentations
    gives all of them, each with inclusion 1.

    A NULL or empty text has one segmentation, of no piece. U+2581 in a text reads as a blank, so such
    a text does not come back as it was and ``round_trip`` is false.
    Rows with a NULL doc_id stay out; rows that repeat a doc_id are sampled one by one, with the
    same random values. Extra columns are ignored; an empty table gives an empty result.
    """
    vocabulary = load_vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]):
        lat, decode = per_worker(
            ("lattices", hash(tuple(vocabulary.text))), lambda: (Lattices(vocabulary), Decoder(vocabulary))
        )
        with np.errstate(over="ignore", divide="ignore"):
            for batch in batches:
                for a in range(0, len(batch), BLOCK):
                    yield _encoded(lat, decode, batch.slice(a, BLOCK), samples, seed)

    return documents_of(docs).mapInArrow(run, SAMPLES)


BLOCK = 128  # documents that are sampled together


def _encoded(lat: Lattices, decode: Decoder, batch: pa.RecordBatch, samples: int, seed: int) -> pa.RecordBatch:
    stored = batch.column("text").to_pylist()
    texts = [t.replace(SPACE, " ") for t in stored]
    doc_id = batch.column("doc_id").to_numpy()
    keys = mix(mix(doc_id.astype(np.int64).view(U64)) + U64(seed))
    rows = [
        (d, r + 1, *found)
        for d, paths in enumerate(_sample_batch(lat, texts, keys, samples))
        for r, found in enumerate(paths)
    ]
    edges = np.concatenate([row[2] for row in rows]) if rows else np.zeros(0, np.int64)
    flat, counts = ids_of(lat, edges, np.array([len(row[2]) for row in rows], np.int64))
    owner = np.array([row[0] for row in rows], np.int64)
    log = np.array([row[3] for row in rows])
    kappa = np.array([row[5] for row in rows])
    same: list[bool] = []
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    for a in range(0, len(rows), 64):  # the gathering takes many times the text's bytes
        sizes = counts[a : a + 64]
        data, borders = decode(flat[offsets[a] : offsets[a] + sizes.sum()], sizes)
        for k, row in enumerate(rows[a : a + 64]):
            source = stored[row[0]].encode("utf-8", "surrogatepass")
            same.append(data[borders[k] : borders[k + 1]].tobytes() == source)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_id[owner]), pa.array([row[1] for row in rows], pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))),
            pa.array(counts), pa.array(log), pa.array([row[4] for row in rows], pa.float64()),
            pa.array(-np.expm1(-np.exp(log - kappa))), pa.array(same, pa.bool_()),
        ],
        ["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip"],
    )


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``sample`` and ``text`` of rows with ``doc_id``, ``sample`` and ``ids``.

    NULL ids decode to NULL; ids outside the vocabulary raise an error.
    """
    vocabulary = load_vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]):
        decode = Decoder(vocabulary)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array([0 if x is None else len(x) for x in lists.to_pylist()], np.int64)
            data, borders = decode(lists.flatten().to_numpy().astype(np.int64), counts)
            text = [
                data[borders[k] : borders[k + 1]].tobytes().decode("utf-8", "replace") if lists[k].is_valid else None
                for k in range(len(counts))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sample"), pa.array(text, pa.string())],
                ["doc_id", "sample", "text"],
            )

    return encoded.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")

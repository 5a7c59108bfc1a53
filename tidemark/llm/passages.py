"""Passages that documents share, by compact windows.

1. A text's tokens are its runs of ``SIZE`` words. For each of ``FUNCTIONS`` hash functions the
   Cartesian tree over the tokens' values groups all subsequences by their minimum: the node of
   position c with subtree l..r is a compact window, the family of subsequences that lie in l..r and
   contain c, which all have the min-hash value of c. Trees are cut where fewer than ``LEAST`` tokens
   are left, so a text of n tokens has about 2n / ``LEAST`` windows.
2. Windows of equal value meet, sorted by document. Each is paired with the first one and with the
   one before it, so m documents with one passage give less than 2m pairs. Exact copies of a text
   count as one document.
3. Pairs of documents at one shift of positions are joined over the functions: at least
   ``AGREE`` functions must have overlapping windows there.
4. Tokens of the overlap, with ``SLACK`` on both sides, are compared: each run of ``LEAST`` tokens
   whose similarity with the other side is at least ``SHARE`` is part of the passage. First the best
   pair of each place of a document is compared, then all pairs that are not inside passages found
   so far on both sides.
5. Pairing with two windows of a value alone would hide what others share beyond it, so equal runs of tokens
   have a way of their own that drops nothing. Of every ``SEED`` tokens in a row at least one run of ``GRAM`` is
   sampled, by its hash alone. Samples that another document has as well are hot. Runs of ``LEAST`` tokens with
   hot samples alone are grouped by hash, and each is a member of its class, named by its first place. Every
   50 words that two texts share are found this way, whoever else has parts of them.
6. The same holds for edited passages. ``NEAR`` of ``LEAST`` tokens are enough, and a word that is put in, left out
   or changed costs at least four, so a run has one edit, with ``SEED`` equal tokens in a row before or after it.
   Where such runs of a class go on with different tokens, and a member is in no passage yet, the tokens after
   each width of the edit are tried: equal runs of a and of ``NEAR`` - a tokens on both sides of it, for every a,
   make one more class. ``NEAR`` to ``LEAST`` - 1 equal tokens in a row are classes like those of step 5.
7. What the count of step 6 misses, as words that repeat nearby cost fewer tokens, goes by pairs once more: ends of
   equal runs that are in no passage yet meet by two tokens at a time, their own and the one ``d`` positions away
   for every d of ``REACH``, unless one passage found so far has both. These pairs are compared like the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import blocks_of, documents_of, settled, settled_by

SIZE, LEAST, SHARE = 5, 46, 0.8  # 46 runs of five words are 50 words
TREE = 40  # tokens at least in a window: a passage of 50 words still has room at both ends
FUNCTIONS, AGREE, SLACK = 4, 2, 8
NEAR = 41  # so many of LEAST tokens are enough: 41 / (2 * 46 - 41) is the first share of at least SHARE
SEED = 21  # of NEAR tokens in two parts one has as many
GRAM = 11  # tokens of a sample; each SEED tokens have one of SEED - GRAM + 1 runs that start there
REACH = tuple(d for k in range(8, 49, 8) for d in (-k, k))
GAP = 6  # tokens from the last one before an edit to the first after it, at most: five are lost to a changed word
BROADCAST_DOCS = 1_000_000  # of 8 bytes; beyond it the join is shuffled
HEAVY, HEAVIES = 2_000, 1_000  # documents that so many pairs look up are broadcast, so many at most
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
WINDOWS = "doc long, value long, f int, l int, c int, r int"
TOKENS = "doc long, n_words long, tokens binary"
FOUND = "doc_id long, start long, stop long, rep_id long, rep_start long, rep_stop long"


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of all nodes of the Cartesian tree with at least ``least`` positions below.

    The first of equal values is the higher node.
    """
    _, l, c, r = block_windows(values, np.array([0, len(values)]), least)
    return list(zip(l.tolist(), c.tolist(), r.tolist()))


def block_windows(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``compact_windows`` of texts that stand one after the other: text, l, c, r of each node.

    A node with ``least`` positions below is the minimum of a run of ``least`` positions. So are the smaller
    values on both sides that end its subtree, so bounds are looked for among such minima alone.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(values) < least:
        return (np.zeros(0, np.int64),) * 4
    none = np.iinfo(values.dtype).min
    low = _over(np.minimum, values, least)
    low[text[: len(low)] != text[least - 1 :]] = none  # runs that reach into the next text
    edge = np.full(least - 1, none, values.dtype)
    peak = _over(np.maximum, np.concatenate([edge, low, edge]), least)
    at = np.flatnonzero((peak == values) & (np.diff(first) >= least)[text])
    v, text = values[at], text[at]
    left = _nearest(v, text, np.greater)
    right = len(v) - 1 - _nearest(v[::-1], text[::-1], np.greater_equal)[::-1]
    l = np.where(left >= 0, at[left] + 1, first[text])
    r = np.where(right < len(v), at[np.minimum(right, len(v) - 1)] - 1, first[text + 1] - 1)
    keep = r - l + 1 >= least
    start = first[text]
    return text[keep], (l - start)[keep], (at - start)[keep], (r - start)[keep]


def _over(reduce: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """Minimum or maximum of each run of ``size`` values."""
    width = 1
    while 2 * width <= size:
        x, width = reduce(x[: len(x) - width], x[width:]), 2 * width
    return reduce(x[: len(x) - (size - width)], x[size - width :])


def _nearest(values: np.ndarray, text: np.ndarray, passes: np.ufunc) -> np.ndarray:
    """Of each value the nearest earlier one of its text that does not pass over it, or -1."""
    out = np.arange(-1, len(values) - 1)
    out[np.flatnonzero(np.diff(text, prepend=-1))] = -1
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        there = out[todo]
        on = passes(values[there], values[todo])
        todo, there = todo[on], there[on]
        out[todo] = out[there]  # what lies between passes over that one, and over this one too
        todo = todo[out[todo] >= 0]
    return out


def _run_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens: a polynomial modulo 2**64."""
    if len(tokens) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        down, up = (np.cumprod(np.append(np.uint64(1), np.full(len(tokens) - 1, b, np.uint64))) for b in (INVERSE, BASE))
        sums = np.append(np.uint64(0), np.cumsum(textvec.mix(tokens) * down))
        return textvec.mix((sums[size:] - sums[:-size]) * up[: len(tokens) - size + 1])


def _range_hashes(tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the tokens from each ``lo`` to before ``hi``, by content as in ``_run_hashes``."""
    if not len(tokens):
        return np.zeros(len(lo), np.uint64)
    with np.errstate(over="ignore"):
        down, up = (np.cumprod(np.append(np.uint64(1), np.full(len(tokens) - 1, b, np.uint64))) for b in (INVERSE, BASE))
        sums = np.append(np.uint64(0), np.cumsum(textvec.mix(tokens) * down))
        return textvec.mix((sums[hi] - sums[lo]) * up[lo])


def _samples(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of runs of ``GRAM`` tokens, one at least in every ``SEED`` tokens of a text in a row.

    A run is sampled if its hash is the least of those in some ``SEED`` tokens, so equal tokens have equal samples.
    ``tokens`` are the halves that ``tokens_of`` keeps. Texts without a run of ``LEAST`` tokens have none.
    """
    runs = _run_hashes(tokens.astype(np.uint64), GRAM)
    width = SEED - GRAM + 1
    if len(runs) < width:
        return np.zeros(0, np.int64), runs[:0]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = _over(np.minimum, runs, width)
    low[text[: len(low)] != text[SEED - 1 :]] = 0
    edge = np.zeros(width - 1, np.uint64)
    peak = _over(np.maximum, np.concatenate([edge, low, edge]), width)
    at = np.flatnonzero((peak == runs) & (runs > 0) & (np.diff(first) >= LEAST)[text[: len(runs)]])
    return at, runs[at]


def windows(docs: DataFrame) -> DataFrame:
    """Windows of all functions, f from 0, and samples: f = FUNCTIONS, with halves of their hash as l and r."""
    salt = textvec.seeds(FUNCTIONS, 41)

    def block(w: textvec.Words, ids: np.ndarray):
        tokens, first = textvec.shingles(w, SIZE, short=False)
        for f in range(FUNCTIONS):
            values = textvec.mix(tokens ^ salt[f])
            text, l, c, r = block_windows(values, first, TREE)
            start, doc = first[text], ids[w.rows.start + text]
            yield doc, values[start + c], f, l, c, r
        at, key = _samples(tokens >> np.uint64(32), first)
        text = np.searchsorted(first, at, "right") - 1
        halves = (key & np.uint64(0xFFFFFFFF), key >> np.uint64(32))
        low, high = (x.astype(np.uint32).view(np.int32) for x in halves)
        yield ids[w.rows.start + text], key, FUNCTIONS, low, at - first[text], high

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            with np.errstate(over="ignore"):
                found = [x for w in textvec.words(batch.column("text")) for x in block(w, ids) if len(x[0])]
            if found:
                doc, value, f, *w = zip(*found)
                columns = [
                    np.concatenate(doc), np.concatenate(value).view(np.int64), np.repeat(np.array(f, np.int32), [len(x) for x in doc]),
                    *[np.concatenate(x).astype(np.int32) for x in w],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "value", "f", "l", "c", "r"])

    return docs.mapInArrow(run, WINDOWS)


def tokens_of(docs: DataFrame) -> DataFrame:
    """Token hashes of whole texts, four bytes each: enough to compare two short passages."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts, rows = [], []
            with np.errstate(over="ignore"):
                for w in textvec.words(batch.column("text")):
                    tokens, first = textvec.shingles(w, SIZE, short=False)
                    tokens = (tokens >> np.uint64(32)).astype(np.uint32)
                    counts += np.diff(w.first).tolist()
                    rows += [tokens[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], ["doc", "n_words", "tokens"])

    return docs.mapInArrow(run, TOKENS)


def _flagged(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Positions of ``own`` in runs of ``LEAST`` tokens that resemble ``other`` enough."""
    return _dense(np.isin(own, other))


def _dense(held: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Positions in runs of ``LEAST`` tokens (of one ``row``) of which the other side holds enough."""
    edge = np.zeros(len(held) + 1, np.int64)
    if len(held) >= LEAST:
        hit = np.concatenate([[0], np.cumsum(held)])
        both = hit[LEAST:] - hit[:-LEAST]
        good = both >= SHARE * (2 * LEAST - both)
        if row is not None:
            good &= row[: len(good)] == row[LEAST - 1 :]
        edge[: len(good)] += good
        edge[LEAST:] -= good
    return np.cumsum(edge[:-1]) > 0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of token hashes as one array, with each row's first (one entry more) and each token's row."""
    raw, at = textvec.utf8(column)
    first = (at - at[0]) // 4
    return np.ascontiguousarray(raw[at[0] : at[-1]]).view(np.uint32), first, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _places(own: np.ndarray, row: np.ndarray, other: np.ndarray, other_row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether each token is among the other side's of the same row, and the first and last place there."""
    mine, theirs = ((r.astype(np.uint64) << np.uint64(32)) | t for t, r in ((own, row), (other, other_row)))
    if not len(theirs):
        return np.zeros(len(mine), bool), mine, mine
    order = np.argsort(theirs, kind="stable")
    theirs = theirs[order]
    head = np.flatnonzero(np.append(True, theirs[1:] != theirs[:-1]))
    at = np.minimum(np.searchsorted(theirs[head], mine), len(head) - 1)
    return theirs[head][at] == mine, order[head][at], order[np.append(head[1:], len(theirs)) - 1][at]


def _verify(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in blocks_of(batch, "own", 1 << 18):
            doc, pivot, lo, other_lo = (part.column(k).to_numpy().astype(np.int64) for k in ("doc", "pivot", "lo", "other_lo"))
            (own, first, row), (other, other_first, other_row) = (_tokens(part.column(k)) for k in ("own", "other"))
            held, low, high = _places(own, row, other, other_row)
            flags = _dense(held, row)
            begin = np.flatnonzero(flags & np.append(True, ~flags[:-1] | (row[1:] != row[:-1]))[: len(flags)])
            if not len(begin):
                continue
            # Both spans end at the outermost tokens that the sides have in common.
            here = np.flatnonzero(held & flags)
            at = np.searchsorted(here, begin)
            low, high, row = np.minimum.reduceat(low[here], at), np.maximum.reduceat(high[here], at), row[begin]
            start, there = lo[row] - first[row], other_lo[row] - other_first[row]
            found = (doc[row], start + here[at], start + here[np.append(at[1:], len(here)) - 1] + SIZE, pivot[row], there + low, there + high + SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc_id", "start", "stop", "rep_id", "rep_start", "rep_stop"])


def _slice(tokens: str, lo: Column, hi: Column) -> Column:
    return F.substring(F.col(tokens), lo * 4 + 1, (hi - lo) * 4)


def _compared(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The passages of pairs of documents, from the tokens around what their windows cover.

    ``pairs`` is a written table and ``tokens`` one in buckets of ``doc``, so that slices alone are moved.
    """
    n = (F.octet_length("tokens") / 4).cast("int")
    own = pairs.join(tokens, "doc").select(
        "doc", "pivot", "shift", F.greatest(F.col("lo") - SLACK, F.lit(0)).alias("lo"),
        F.least(F.col("hi") + SLACK, n - 1).alias("hi"), "tokens",
    ).withColumn("own", _slice("tokens", F.col("lo"), F.col("hi") + 1)).drop("tokens")
    there = tokens.withColumnRenamed("doc", "pivot")
    # What many pairs look up would make one long task of its bucket.
    most = max(HEAVY, pairs.count() // HEAVIES)
    heavy = settled(pairs.groupBy("pivot").count().where(F.col("count") > most).select("pivot"))
    if heavy.isEmpty():
        other = own.join(there, "pivot")
    else:
        heavy = F.broadcast(heavy)
        other = own.join(heavy, "pivot", "left_anti").join(there, "pivot").unionByName(
            own.join(F.broadcast(there.join(heavy, "pivot", "left_semi")), "pivot")
        )
    other = other.withColumns(
        {
            "other_lo": F.greatest(F.col("lo") - F.col("shift") - SLACK, F.lit(0)),
            "other_hi": F.least(F.col("hi") - F.col("shift") + SLACK, n - 1),
        }
    ).withColumn("other", _slice("tokens", F.col("other_lo"), F.col("other_hi") + 1))
    return other.select("doc", "pivot", "lo", "own", "other_lo", "other").mapInArrow(_verify, FOUND)


def _parts(batches: Iterator[pa.RecordBatch], nodes: str, *more: str):
    """Blocks of documents with a list ``nodes`` of places.

    Ids, tokens, each text's first token and each token's text, each node's first token and its fields; and columns ``more``.
    """
    for batch in batches:
        for part in blocks_of(batch, "tokens"):
            tokens, first, row = _tokens(part.column("tokens"))
            lists = part.column(nodes)
            base = np.repeat(first[:-1], lists.value_lengths().to_numpy())
            yield part.column("doc").to_numpy(), tokens, first, row, base, lists.flatten(), *[part.column(c) for c in more]


def _shared(tokens: np.ndarray, row: np.ndarray, hot: np.ndarray, live: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` tokens start that have a hot sample in every ``SEED`` tokens, and a ``live`` one in some."""
    if len(tokens) < size:
        return np.zeros(0, np.int64)
    runs, width = _run_hashes(tokens.astype(np.uint64), GRAM), SEED - GRAM + 1
    low = _over(np.minimum, runs, width)

    def sampled(at: np.ndarray) -> np.ndarray:
        """How many of the first tokens begin ``SEED`` tokens whose sample is among ``at``."""
        held = np.full(len(runs), np.iinfo(np.uint64).max)
        held[at] = runs[at]
        return np.append(0, np.cumsum(_over(np.minimum, held, width) == low))

    inside, n = size - SEED + 1, len(tokens) - size + 1
    hots, lives = (x[inside : inside + n] - x[:n] for x in (sampled(hot), sampled(hot[live])))
    return np.flatnonzero((hots == inside) & (lives > 0) & (row[:n] == row[size - 1 :]))


def _expanded(size: int):
    """The runs of ``_shared``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for doc, tokens, first, row, base, nodes in _parts(batches, "nodes"):
            hot = base + nodes.field("c").to_numpy().astype(np.int64)
            at = _shared(tokens, row, hot, nodes.field("live").to_numpy(zero_copy_only=False), size)
            runs, whose = _run_hashes(tokens.astype(np.uint64), size)[at], row[at]
            yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(doc[whose]), pa.array((at - first[whose]).astype(np.int32))], ["run", "doc", "at"])

    return run


def _around(batches: Iterator[pa.RecordBatch]):
    """Runs of ``SEED`` tokens of ``_shared``: with the tokens before and after, a hash of all an edit beside them can need, and whether no passage has that."""
    far = GAP + SLACK + NEAR - SEED
    for doc, tokens, first, row, base, nodes, spans in _parts(batches, "nodes", "spans"):
        hot = base + nodes.field("c").to_numpy().astype(np.int64)
        at = _shared(tokens, row, hot, nodes.field("live").to_numpy(zero_copy_only=False), SEED)
        whose, wide = row[at], tokens.astype(np.uint64)
        begin, end = first[whose], first[whose + 1]
        lo, hi = np.maximum(at - far, begin), np.minimum(at + SEED + far, end)
        with np.errstate(over="ignore"):
            place = textvec.mix(((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - at).astype(np.uint64))
            ctx = textvec.mix(_range_hashes(wide, lo, hi) ^ place)
        # A text's border differs from every token of 32 bits.
        around = np.concatenate([[-1], tokens.astype(np.int64), [-1]])
        before, after = np.where(at == begin, -1, around[at]), np.where(at + SEED == end, -2, around[np.minimum(at + SEED + 1, len(around) - 1)])
        # Any run of LEAST tokens with an edit beside the equal ones lies between these words. No span is in another one.
        lo, hi = np.maximum(at - (LEAST - SEED + 1), begin) - begin, np.minimum(at + LEAST, end) - begin + SIZE - 1
        counts, (start, stop) = spans.value_lengths().to_numpy(), (spans.flatten().field(k).to_numpy() for k in ("start", "stop"))
        of = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((start, of))
        known, stop = ((of << 32) + start)[order], stop[order]
        last = np.searchsorted(known, (whose << 32) + lo, "right") - 1
        inside = np.zeros(len(at), bool)
        some = np.flatnonzero(last >= 0)
        inside[some] = (known[last[some]] >> 32 == whose[some]) & (stop[last[some]] >= hi[some])
        runs = _run_hashes(wide, SEED)[at]
        columns = [runs.view(np.int64), ctx.view(np.int64), doc[whose], (at - begin).astype(np.int32), before, after, ~inside]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["run", "ctx", "doc", "at", "before", "after", "open"])


def _listed(nodes: DataFrame, tokens: DataFrame, *fields: str) -> DataFrame:
    """Documents with their tokens and the list of their nodes."""
    return nodes.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("nodes")).join(tokens, "doc").select("doc", "tokens", "nodes")


def _shared_runs(nodes: DataFrame, tokens: DataFrame, size: int = LEAST) -> DataFrame:
    """Passages of equal runs: each run with the first place of its class, adjoining ones as one passage."""
    runs = settled(_listed(nodes, tokens, "c", "live").mapInArrow(_expanded(size), "run long, doc long, at int"))
    # One shuffle and one sort; the frame ends at the row, so that no group is held.
    places = Window.partitionBy("run").orderBy("doc", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumns({"rep": F.first("doc").over(places), "rep_at": F.first("at").over(places)})
    members = runs.where("doc <> rep").select("doc", "rep", (F.col("at") - F.col("rep_at")).alias("shift"), "at")
    before = F.row_number().over(Window.partitionBy("doc", "rep", "shift").orderBy("at"))
    spans = members.withColumn("island", F.col("at") - before).groupBy("doc", "rep", "shift", "island").agg(
        F.min("at").cast("long").alias("start"), (F.max("at") + size + SIZE - 1).cast("long").alias("stop")
    )
    return spans.select(
        F.col("doc").alias("doc_id"), "start", "stop", F.col("rep").alias("rep_id"),
        (F.col("start") - F.col("shift")).alias("rep_start"), (F.col("stop") - F.col("shift")).alias("rep_stop"),
    )


def _beyond(batches: Iterator[pa.RecordBatch]):
    """For the end ``p`` of equal tokens on one side of an edit, the token behind each width of the edit."""
    for doc, tokens, first, row, base, nodes in _parts(batches, "nodes"):
        run, p, side, after = (nodes.field(k).to_numpy().astype(np.int64) for k in ("run", "p", "side", "next"))
        is_open = nodes.field("open").to_numpy(zero_copy_only=False)
        whose, p = row[base], p + base
        for gap in range(1, GAP + SLACK):
            at = p + gap * side
            mine = np.flatnonzero((at >= first[whose]) & (at < first[whose + 1]))
            with np.errstate(over="ignore"):
                key = textvec.mix(run[mine].view(np.uint64) ^ textvec.mix(tokens[at[mine]].astype(np.uint64) + np.uint64(1 << 40)))
            key = key * np.uint64(2) + (side[mine] > 0).astype(np.uint64)
            columns = [key.view(np.int64), doc[whose[mine]], (p - base)[mine].astype(np.int32), side[mine].astype(np.int32), np.full(len(mine), gap, np.int32)]
            columns += [after[mine], is_open[mine]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc", "p", "side", "gap", "next", "open"])


WIDTHS = tuple(range(SEED, NEAR, 5))  # the longer side of an edit, roughly: so many tokens, and up to four more


def _split(fine: bool):
    """Equal tokens on both sides of an edit, the longer side where the edit was found.

    First what each of ``WIDTHS`` needs at least, its number as ``width``; where others have that, ``fine`` takes
    each length of the longer side, which leaves ``NEAR`` tokens on both sides together.
    """
    steps = [(w, w + i, NEAR - w - i) for w in WIDTHS for i in range(5)] if fine else [(w, w, max(NEAR - w - 4, 1)) for w in WIDTHS]

    def run(batches: Iterator[pa.RecordBatch]):
        for doc, tokens, first, row, base, nodes in _parts(batches, "nodes"):
            p, side, gap = (nodes.field(k).to_numpy().astype(np.int64) for k in ("p", "side", "gap"))
            width, is_open = nodes.field("width").to_numpy() if fine else None, nodes.field("open").to_numpy(zero_copy_only=False)
            whose, wide = row[base], tokens.astype(np.uint64)
            # The last token before the edit and the first one after it.
            left = base + np.where(side > 0, p, p - gap)
            right = left + gap
            for w, most, rest in steps:
                for way in (1, -1):
                    a, b = (most, rest)[::way]
                    mine = (side == way) & (left - a + 1 >= first[whose]) & (right + b <= first[whose + 1])
                    mine = np.flatnonzero(mine & (width == w) if fine else mine)
                    if not len(mine):
                        continue
                    before, after = _run_hashes(wide, a)[left[mine] - a + 1], _run_hashes(wide, b)[right[mine]]
                    with np.errstate(over="ignore"):
                        key = textvec.mix(before ^ textvec.mix(after + np.uint64(a)))
                    columns = [key.view(np.int64), doc[whose[mine]], p[mine].astype(np.int32), side[mine].astype(np.int32), gap[mine].astype(np.int32), np.full(len(mine), a if fine else w, np.int32), is_open[mine]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc", "p", "side", "gap", "width", "open"])

    return run


def _edited(nodes: DataFrame, covered: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages with one edit: classes of equal tokens on both sides of it, each with the first place of its class.

    Also the ends of equal runs that go on with different tokens, where edits were looked for.
    """
    kinds = "run long, ctx long, doc long, at int, before long, after long, open boolean"
    listed = _listed(nodes, tokens, "c", "live").join(covered.withColumnRenamed("doc_id", "doc"), "doc", "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    runs = listed.select("doc", "tokens", "nodes", F.coalesce("spans", none).alias("spans")).mapInArrow(_around, kinds)
    # Members with the same tokens far around share more than LEAST there, so one stands for all.
    same = Window.partitionBy("run", "ctx").orderBy("doc", "at")
    whole = Window.partitionBy("run")
    runs = runs.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth", "ctx")
    flags = {"any": F.max("open").over(whole)} | {k: F.min(c).over(whole) < F.max(c).over(whole) for k, c in (("r", "after"), ("l", "before"))}
    runs = runs.withColumns(flags).where("any AND (r OR l)")
    sides = F.explode(F.filter(F.array(F.when(F.col("r"), F.lit(1)), F.when(F.col("l"), F.lit(-1))), lambda x: x.isNotNull())).alias("side")
    right = F.col("side") > 0
    ends = runs.select("run", "doc", "at", "before", "after", "open", sides).select(
        "run", "doc", "side", F.when(right, F.col("at") + SEED - 1).otherwise(F.col("at")).alias("p"),
        F.when(right, F.col("after")).otherwise(F.col("before")).alias("next"), "open",
    )
    ends = settled(ends)
    kept = "key long, doc long, p int, side int, gap int, next long, open boolean"
    tried = _listed(ends, tokens, "run", "p", "side", "next", "open").mapInArrow(_beyond, kept)
    # An edit parts members that go on with different tokens and meet again.
    whole = Window.partitionBy("key")
    meet = {"parted": F.min("next").over(whole) < F.max("next").over(whole), "any": F.max(F.expr(f"open AND gap <= {GAP}")).over(whole)}
    tried = settled(tried.withColumns(meet).where("parted AND any").select("doc", "p", "side", "gap", "open").distinct())
    kinds = "key long, doc long, p int, side int, gap int, width int, open boolean"
    tried = _listed(tried, tokens, "p", "side", "gap", "open").mapInArrow(_split(False), kinds)
    meet |= {"parted": F.min("doc").over(whole) < F.max("doc").over(whole)}
    tried = settled(tried.withColumns(meet).where("parted AND any").select("doc", "p", "side", "gap", "open", "width").distinct())
    split = _listed(tried, tokens, "p", "side", "gap", "open", "width").mapInArrow(_split(True), kinds)
    # A wide edit leaves its own text no passage: such a member counts for the first one alone.
    last = F.when(F.col("side") > 0, F.col("p")).otherwise(F.col("p") - F.col("gap"))
    start = (last - F.col("width") + 1).cast("long")
    split = split.select("key", "doc", last.alias("p"), "gap", "open", start.alias("start"), (start + NEAR + F.col("gap") - 1 + SIZE - 1).alias("stop"))
    mine = ("doc", "start", "stop", "p", "gap", "open")
    place = Window.partitionBy("key").orderBy("doc", "start", "gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = split.withColumn("rep", F.first(F.struct(*mine)).over(place)).where("doc <> rep.doc").where(f"least(gap, rep.gap) <= {GAP}")
    own, rep, turned = F.struct(*mine), F.col("rep"), F.col("gap") > GAP
    split = split.select(F.when(turned, rep).otherwise(own).alias("own"), F.when(turned, own).otherwise(rep).alias("rep"))
    # A first one that is in no passage yet is found as the other side of its members.
    split = split.where("own.open OR rep.open")
    split = split.groupBy("own.doc", "own.p", "own.gap", F.col("rep.doc").alias("rep_id"), F.col("rep.p").alias("rep_p"), F.col("rep.gap").alias("rep_gap")).agg(
        F.min("own.start").alias("start"), F.max("own.stop").alias("stop"), F.min("rep.start").alias("rep_start"), F.max("rep.stop").alias("rep_stop"),
    )
    return split.select(F.col("doc").alias("doc_id"), "start", "stop", "rep_id", "rep_start", "rep_stop"), ends


def _both_sides(found: DataFrame) -> DataFrame:
    reps = found.select(
        F.col("rep_id").alias("doc_id"), F.col("rep_start").alias("start"), F.col("rep_stop").alias("stop"),
        "rep_id", "rep_start", "rep_stop",
    )
    return found.unionByName(reps)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of at least 50 words that other documents have as well.

    One row per passage of a document: ``doc_id``, ``start``, ``stop`` (words, end exclusive), and
    the representative's ``rep_id``, ``rep_start``, ``rep_stop``. Representatives have rows of their
    own with rep_id = doc_id. Spans are cut back to the outermost runs of five words that both sides
    have, so that of an edited passage can be a little shorter than 50 words. A text that other documents copy exactly is one passage, represented by
    the smallest doc_id; its other passages are listed for that document alone, so copies are a
    membership and not pairs. Words are runs of non-blank bytes, A-Z folded.

    A NULL or short text has no passage. Rows with a NULL doc_id stay out; rows that repeat a doc_id
    and a text count once, and other rows of one doc_id are compared like documents. Extra columns
    are ignored; an empty table gives an empty result.
    """
    hashes = (F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    docs = documents_of(docs).select("doc_id", "text", *hashes)
    blobs = settled(docs.select("doc_id", "h1", "h2").distinct())
    # Work goes by node: the doc_id, or for each text of a doc_id with several a number of its own.
    several = _spread(settled(blobs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several"))))
    own = F.when(F.col("several"), -2 - F.abs(F.xxhash64("doc_id", "h1", "h2") / 2).cast("long")).otherwise(F.col("doc_id"))

    def noded(rows: DataFrame) -> DataFrame:
        return rows.join(several, "doc_id", "left").withColumn("node", own).drop("several")

    blobs = settled(noded(blobs))
    classes = blobs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.min_by("node", "doc_id").alias("of"), F.count(F.lit(1)).alias("n"))
    copies = settled(blobs.join(classes.where("n > 1"), ["h1", "h2"]).select("doc_id", "h1", "h2", "node", "first", "of"))
    extra = settled(copies.where("node <> of").select(F.col("node").alias("doc_id")).distinct())
    docs = noded(docs).select(F.col("node").alias("doc_id"), "text").join(_spread(extra), "doc_id", "left_anti")

    rows = windows(docs).repartition("value").sortWithinPartitions("value", "doc", "c")
    pairs = rows.mapInArrow(_paired(True), PAIRED)
    joined = pairs.groupBy("doc", "pivot", "shift").agg(
        F.bit_count(F.bit_or(F.expr("shiftleft(1, f)"))).alias("agree"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.min("c").alias("from"), F.max("c").alias("upto"),
    ).where((F.col("agree") >= AGREE) | (F.col("doc") == F.col("pivot")))
    joined = settled(joined)
    hot = joined.where("doc = pivot").select("doc", F.col("shift").alias("c"), "lo", "hi", F.lit(True).alias("live"))
    joined = joined.where("doc <> pivot")

    needed = joined.select("doc").union(joined.select("pivot")).union(copies.select("of")).union(hot.select("doc")).distinct()
    tokens = _tokens_for(docs, needed)

    # The best pair of each place first.
    place = F.floor(F.col("from") / LEAST)
    rank = F.struct("agree", F.col("upto") - F.col("from"), -F.col("pivot"), "shift")
    best = joined.groupBy("doc", place.alias("place")).agg(
        F.max(F.struct(rank.alias("rank"), F.struct(*joined.columns).alias("pair")))["pair"].alias("pair")
    ).select("pair.*")
    best = settled(best)
    found = settled(_compared(best, tokens))
    covered = _covered(found)
    rest = joined.join(best, ["doc", "pivot", "shift"], "left_anti")
    for side, shift in (("doc", F.lit(0)), ("pivot", F.col("shift"))):
        rest = _inside(rest, covered, side, F.col("from") - shift, F.col("upto") - shift + SIZE)
    rest = settled(rest.where("NOT (in_doc AND in_pivot)").select(*joined.columns))
    found = settled(found.unionByName(_compared(rest, tokens)))

    found = settled(found.unionByName(_shared_runs(hot, tokens)))

    # Samples whose class has a member that is not in the middle of a passage yet.
    around = F.greatest(F.col("c") - (LEAST - GRAM), F.lit(0)), F.col("c") + LEAST + SIZE - 1
    hot = settled(_inside(hot.drop("live"), _covered(found), "doc", *around))
    live = hot.where("NOT in_doc").select("lo", "hi").distinct().withColumn("live", F.lit(True))
    hot = settled(hot.join(live, ["lo", "hi"], "left").select("doc", "c", F.coalesce("live", F.lit(False)).alias("live")))
    hot = hot.join(hot.where("live").select("doc").distinct(), "doc", "left_semi")
    found = settled(found.unionByName(_shared_runs(hot, tokens, NEAR)))
    edited, ends = _edited(hot, _covered(found), tokens)
    found = settled(found.unionByName(edited))

    # Ends of equal runs that are in no passage yet, by two tokens at a time.
    covered, far = _covered(found), max(REACH)
    hot = ends.where("open").select("doc", F.col("p").alias("c")).distinct()
    hot = _inside(hot, covered, "doc", F.col("c") - far, F.col("c") + far + SIZE).where("NOT in_doc").drop("in_doc")
    away = F.explode(F.array(*[F.lit(d) for d in REACH])).alias("d")
    bounds = F.greatest(F.col("c") - LEAST + 1, F.lit(0)).alias("lo"), (F.col("c") + LEAST - 1).alias("hi")
    hot = hot.select("doc", "c", *bounds, away).where("c + d >= 0")
    # Two tokens inside one passage tell nothing new.
    ends = F.least(F.col("c"), F.col("c") + F.col("d")), F.greatest(F.col("c"), F.col("c") + F.col("d")) + SIZE
    hot = settled(_inside(hot, covered, "doc", *ends).where("NOT in_doc").drop("in_doc"))
    near = hot.join(tokens, "doc").where("4 * (c + d) < octet_length(tokens)")
    value = F.xxhash64("d", _slice("tokens", F.col("c"), F.col("c") + 1), _slice("tokens", F.col("c") + F.col("d"), F.col("c") + F.col("d") + 1))
    near = near.select("doc", value.alias("value"), F.lit(0).alias("f"), F.col("lo").alias("l"), "c", F.col("hi").alias("r"))
    again = near.repartition("value").sortWithinPartitions("value", "doc", "c").mapInArrow(_paired(False), PAIRED)
    again = again.groupBy("doc", "pivot", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Pairs that were compared before go on where they reach further now.
    earlier = joined.select("doc", "pivot", "shift", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    again = again.join(earlier, ["doc", "pivot", "shift"], "left").where("_lo IS NULL OR lo < _lo OR hi > _hi").select(
        "doc", "pivot", "shift", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi")
    )
    found = settled(found.unionByName(_compared(settled(again), tokens)))

    long_enough = tokens.where(F.col("n_words") >= LEAST + SIZE - 1).select(F.col("doc").alias("of"), "n_words")
    zero = F.lit(0).cast("long")
    whole = copies.join(long_enough, "of").select(
        "doc_id", zero.alias("start"), F.col("n_words").alias("stop"), F.col("first").alias("rep_id"),
        zero.alias("rep_start"), F.col("n_words").alias("rep_stop"),
    )
    names = blobs.where("node <> doc_id").select("node", F.col("doc_id").alias("name"))
    out = _both_sides(found)
    for side in ("doc_id", "rep_id"):
        named = names.withColumnRenamed("node", side)
        out = out.join(named, side, "left").withColumn(side, F.coalesce("name", side)).drop("name")
    return out.select(*whole.columns).unionByName(whole).distinct()


def _covered(found: DataFrame) -> DataFrame:
    """Per document the spans of its passages that lie in no other one."""
    earlier = Window.partitionBy("doc_id").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    spans = _both_sides(found).select("doc_id", "start", "stop").distinct().withColumn("reach", F.max("stop").over(earlier))
    return spans.where("reach IS NULL OR stop > reach").groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _inside(rows: DataFrame, covered: DataFrame, side: str, start: Column, stop: Column) -> DataFrame:
    """``in_{side}``: whether the words from ``start`` to ``stop`` of a document are inside a passage."""
    inside = F.exists("spans", lambda x: (x["start"] <= start) & (stop <= x["stop"]))
    rows = rows.join(covered.withColumnRenamed("doc_id", side), side, "left")
    return rows.withColumn(f"in_{side}", F.coalesce(inside, F.lit(False))).drop("spans")


def _tokens_for(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Tokens of the documents in ``needed`` (one column), one row each."""
    needed = settled(needed.toDF("doc"))
    texts = docs.join(_spread(needed), F.col("doc_id") == F.col("doc"), "left_semi")
    return settled_by(tokens_of(texts.dropDuplicates(["doc_id"]) if docs_repeat(texts) else texts), "doc")


def _spread(ids: DataFrame) -> DataFrame:
    """Broadcast as long as they are few: texts stay where they are then."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids


def docs_repeat(texts: DataFrame) -> bool:
    rows, ids = texts.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    return rows > ids


PAIRED = "doc long, pivot long, shift int, f int, c int, lo int, hi int"


def _paired(seeded: bool):
    """Each window with the first one of its value and with the one before, if other documents'.

    Rows come sorted by value, document and place. ``lo`` and ``hi`` bound the positions of either
    window, as positions of the document. If ``seeded``, samples (f = FUNCTIONS and up) are
    not paired: those of values that two documents or more hold come out as pairs of a document with
    itself whose shift is the sample's position; ``lo`` and ``hi`` are what they came with.
    """
    names = ("value", "doc", "l", "c", "r", "f")

    def run(batches: Iterator[pa.RecordBatch]):
        held = None  # the first and the last window of the current group, and its documents so far
        early: list = []  # windows of a group's first document, as long as there is no second
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [batch.column(k).to_numpy() for k in names]
            skip, docs_before = 0, 0
            if held is not None:
                rows = [np.concatenate([np.array([a, b], x.dtype), x]) for a, b, x in zip(*held[:2], rows)]
                skip, docs_before = 2, held[2]
            value, doc, l, c, r, f = rows
            head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            sizes = np.diff(np.append(head, len(value)))
            first = np.repeat(head, sizes)
            # Number of each row's document within its group, from 1.
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
            if skip:
                fresh[:2] = False  # they were counted before
            number = np.cumsum(fresh)
            number = number - np.repeat(number[head] - fresh[head], sizes)
            number[: sizes[0]] += docs_before
            at = np.arange(skip, len(value))
            before = np.maximum(at - 1, first[at])
            take = np.concatenate([at, at[before != first[at]]])
            other = np.concatenate([first[at], before[before != first[at]]])
            different = (doc[take] != doc[other]) & ~((f[take] >= FUNCTIONS) & seeded)
            take, p = take[different], other[different]
            shift = c[take] - c[p]
            out = [doc[take], doc[p], shift, f[take], c[take], np.minimum(l[take], l[p] + shift), np.maximum(r[take], r[p] + shift)]
            if seeded:
                several = np.repeat(number[np.append(head[1:], len(value)) - 1] > 1, sizes)
                mine = np.flatnonzero((f >= FUNCTIONS) & (np.arange(len(value)) >= skip))
                hot = mine[several[mine]]
                own = [doc[hot], doc[hot], c[hot], f[hot], c[hot], l[hot], r[hot]]
                if early and several[0]:  # the group that began in an earlier batch has a second document now
                    own = [np.concatenate([x, *y]) for x, y in zip(own, zip(*early))]
                if several[0] or len(head) > 1:
                    early = []
                # Windows of the last group wait while it has one document.
                wait = mine[(mine >= head[-1]) & ~several[mine]]
                if len(wait):
                    early.append([doc[wait], doc[wait], c[wait], f[wait], c[wait], l[wait], r[wait]])
                out = [np.concatenate([x, y]) for x, y in zip(out, own)]
            held = tuple(x[head[-1]] for x in rows), tuple(x[-1] for x in rows), int(number[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc", "pivot", "shift", "f", "c", "lo", "hi"])

    return run

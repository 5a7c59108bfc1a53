"""Toxicity: Levenshtein automata over a lexicon trie, and a score of each hit's context.

The lexicon is a list of plain insults and what labelled rows add to it: words, and stems that
stand for every word that begins with them. All its terms form one trie. The trie intersected with
the Levenshtein automaton of each term (one edit from ``ONE_EDIT`` letters on, for insults two from
``TWO_EDITS`` on, none for stems; a swap of neighbours is one edit) is made deterministic once, on
the driver, and its table sent to the tasks. There all words of a batch walk through the table
together, one byte per step; most die after a few steps.

Around a hit, a window of ``WINDOW`` words tells quotation (an open quotation mark before and a
closing one after it, or a word of reporting) from abuse (direct address). A fuzzy hit on a word
that clean labelled rows use about as often as toxic ones is a word of its own and no hit. A logistic regression on
counts of such hits gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec
from tidemark.llm.common import blocks_of, documents_of, forget, settled

# Plain insults, words of reporting, words of address.
INSULTS = (
    "bastard clown coward creep degenerate disgusting dumb dumbass filth fool freak garbage idiot "
    "imbecile jerk loser lunatic moron parasite pathetic pig scum scumbag stupid trash vermin "
    "worthless wretch"
).split()
REPORTING = (
    "said says say wrote writes called calls quote quoted quotes reported heißt sagte schrieb "
    "nannte zitierte dit écrit appelé cité dijo escribió llamó citó"
).split()
ADDRESS = "you your you're youre yourself ur du dich dein deine tu te toi vous eres usted".split()

ONE_EDIT, TWO_EDITS, WINDOW = 5, 9, 8
SAMPLE_ROWS = 20_000  # labelled rows the model is fitted on; all of them where there are fewer
LEAST_ROWS, LEAST_LIFT = 8, 10.0  # of a learned term; how many there are has no bound
OWN_LIFT = 3.0  # a spelling that toxic rows have less than so many times as often is a word of its own
SHORT_STEM, LONG_STEM, LEAST_FORMS = 4, 12, 3  # letters of a stem, and words that begin with it

HIT = "start int, end int, term string, distance int, surface string, quoted boolean, direct boolean"
HITS = f"doc_id long, n_words long, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>"
FEATURES = ["any_exact", "more_exact", "any_fuzzy", "more_fuzzy", "any_learned", "more_learned", "quoted", "direct"]


class Automaton(NamedTuple):
    """``table[state, group[byte]]`` is the next state; 0 is dead, 1 the start."""

    group: np.ndarray
    table: np.ndarray
    term: np.ndarray  # per state the term accepted there, or -1
    distance: np.ndarray
    terms: tuple[str, ...]


def allowed(term: str) -> int:
    n = len(term)
    return 2 if n >= TWO_EDITS else 1 if n >= ONE_EDIT else 0


def build_automaton(terms: tuple[str, ...], learned: tuple[str, ...] = (), stems: tuple[str, ...] = ()) -> Automaton:
    """Subset construction over (trie node, edits, byte still owed by a swap).

    ``learned`` words are accepted with one edit at most, ``stems`` as they are and with anything
    after them; those are named with a star.
    """
    edits = {f"{t}*": 0 for t in stems} | {t: min(1, allowed(t)) for t in learned} | {t: allowed(t) for t in terms}
    terms = tuple(sorted(edits))
    child: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    open_ends: dict[int, int] = {}
    budget = [0]
    for t, term in enumerate(terms):
        node = 0
        budget[0] = max(budget[0], edits[term])
        for byte in term.rstrip("*").encode():
            if byte not in child[node]:
                child.append({})
                budget.append(0)
                child[node][byte] = len(child) - 1
            node = child[node][byte]
            budget[node] = max(budget[node], edits[term])
        (open_ends if term.endswith("*") else ends)[node] = t
    letters = sorted({b for c in child for b in c})
    group = np.zeros(256, np.int64)
    group[letters] = np.arange(1, len(letters) + 1)
    for b in letters:
        if 97 <= b <= 122:
            group[b - 32] = group[b]

    def closed(states: set) -> frozenset:
        """With letters of the term left out, and of equal states the one of fewest edits."""
        best: dict = {}
        todo = list(states)
        while todo:
            node, e, owed = todo.pop()
            if e > budget[node] or best.get((node, owed), 9) <= e:
                continue
            best[node, owed] = e
            if owed is None:
                todo += [(n, e + 1, None) for n in child[node].values()]
        return frozenset((node, e, owed) for (node, owed), e in best.items())

    def step(states: frozenset, byte: int | None) -> frozenset:
        out = set()
        for node, e, owed in states:
            if owed is not None:
                if owed == byte:
                    out.add((node, e, None))
                continue
            out.add((node, e + (node not in open_ends or e > 0), None))
            for b, n in child[node].items():
                out.add((n, e + (b != byte), None))
                if byte in child[n] and byte != b:
                    out.add((child[n][byte], e + 1, b))
        return closed(out)

    start = closed({(0, 0, None)})
    number, rows, todo = {frozenset(): 0, start: 1}, [[0] * (len(letters) + 1)], [start]
    for states in todo:
        # Bytes that no state can use all lead where an unknown one does.
        used = {owed for _, _, owed in states if owed is not None}
        for node, _, owed in states:
            if owed is None:
                used.update(child[node])
                used.update(*(child[n] for n in child[node].values()))
        row: list[int] = []
        for byte in [None, *sorted(used)]:
            after = step(states, byte)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            if byte is None:
                row = [number[after]] * (len(letters) + 1)
            else:
                row[group[byte]] = number[after]
        rows.append(row)
    term, distance = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
    for states, k in number.items():
        done = [(e, 0, ends[n]) for n, e, owed in states if owed is None and n in ends and e <= edits[terms[ends[n]]]]
        done += [(e, 1, open_ends[n]) for n, e, owed in states if owed is None and n in open_ends and e == 0]
        if done:
            distance[k], _, term[k] = min(done)
    return Automaton(group, np.array(rows, np.int32), term, distance, terms)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, and signs that belong to a word only between two of those."""
    solid = np.zeros(256, bool)
    solid[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    sign = np.zeros(256, bool)
    sign[list(b"@$*'!")] = True
    return solid, sign


def _accepted(auto: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Words that end in an accepting state, and that state."""
    state = np.ones(len(start), np.int64)
    live, at = np.arange(len(start)), start.copy()
    done_word, done_state = [], []
    while len(live):
        state = auto.table[state, auto.group[data[at]]]
        at = at + 1
        over = (at == end[live]) & (auto.term[state] >= 0)
        done_word.append(live[over])
        done_state.append(state[over])
        go = (state > 0) & (at < end[live])
        live, state, at = live[go], state[go], at[go]
    return np.concatenate([*done_word, live]), np.concatenate([*done_state, live])


OPEN, CLOSE = '"“„«‘', '"”“»’'


def _context(text: bytes, starts, ends, k: int) -> tuple[bool, bool]:
    """Quoted? Direct address? From ``WINDOW`` words on both sides of word ``k``."""
    lo, hi = max(0, k - WINDOW), min(len(starts), k + WINDOW + 1)
    before = text[starts[lo] - 1 if starts[lo] else 0 : starts[k]].decode("utf-8", "ignore")
    after = text[ends[k] : ends[hi - 1] + 4].decode("utf-8", "ignore")
    opened = any(
        before.count(o) % 2 == 1 if o == c else before.rfind(o) > before.rfind(c)
        for o, c in zip(OPEN, CLOSE)
        if o in before
    )
    near = {text[s:e].decode("utf-8", "ignore").lower() for s, e in zip(starts[lo:hi], ends[lo:hi])}
    quoted = (opened and any(c in after for c in CLOSE)) or not near.isdisjoint(REPORTING)
    return quoted, not near.isdisjoint(ADDRESS)


def find_hits(docs: DataFrame, auto: Automaton) -> DataFrame:
    """``doc_id``, ``n_words`` and ``hits`` (code points, end exclusive) of whole texts."""
    solid, sign = _letters()

    def one(text: bytes, starts, ends, k: int, state: int) -> dict:
        quoted, direct = _context(text, starts, ends, k)
        word = text[starts[k] : ends[k]].decode("utf-8", "ignore")
        at = len(text[: starts[k]].decode("utf-8", "ignore"))
        return {
            "start": at, "end": at + len(word), "term": auto.terms[auto.term[state]],
            "distance": int(auto.distance[state]), "surface": word.lower(), "quoted": quoted, "direct": direct,
        }

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for batch in (block for batch in batches for block in blocks_of(batch)):
            raw, at = textvec.utf8(batch.column("text"))
            data = raw[at[0] : at[-1]]
            base = at - at[0]
            inside = solid[data]
            inside[1:-1] |= sign[data[1:-1]] & inside[:-2] & inside[2:]
            edge = np.zeros(len(data) + 1, bool)
            edge[0] = edge[-1] = True
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[base] = True
            borders = np.flatnonzero(edge)
            keep = inside[borders[:-1]] if len(data) else np.zeros(0, bool)
            start, end = borders[:-1][keep], borders[1:][keep]
            first = np.searchsorted(start, base)
            word, state = _accepted(auto, data, start, end)
            order = np.argsort(word, kind="stable")
            word, state = word[order], state[order]
            doc = np.searchsorted(first, word, "right") - 1
            hits: list[list[dict]] = [[] for _ in range(len(batch))]
            for d in np.unique(doc):
                a, b = first[d], first[d + 1]
                text = data[base[d] : base[d + 1]].tobytes()
                starts, ends = start[a:b] - base[d], end[a:b] - base[d]
                hits[d] = [one(text, starts, ends, k - a, s) for k, s in zip(word[doc == d], state[doc == d])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(hits, HIT_TYPE)],
                ["doc_id", "n_words", "hits"],
            )

    return docs.mapInArrow(run, HITS)


HIT_TYPE = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("distance", pa.int32()),
         ("surface", pa.string()), ("quoted", pa.bool_()), ("direct", pa.bool_())]
    )
)


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


class Model(NamedTuple):
    auto: Automaton
    words: tuple[str, ...]  # near the lexicon, but words of their own
    weights: tuple[float, ...]
    intercept: float


def _beyond_chance(pos: int, n: int, share: float, tested: int) -> float:
    """Chernoff's bound on ``pos`` toxic rows among ``n`` by chance, as a log, less that of one in ``tested``."""
    p = pos / n
    apart = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if pos < n else 0.0)
    return n * apart - math.log(max(tested, 1))


def _begun(batches: Iterator[pa.RecordBatch]):
    """Beginnings of each row's words, once a row."""
    forget()
    for batch in (block for batch in batches for block in _rows_of(batch)):
        flags, terms = [], []
        for flag, own in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist()):
            stems = {w[:k] for w in own for k in range(SHORT_STEM, min(len(w), LONG_STEM) + 1)}
            terms += stems
            flags += [flag] * len(stems)
        yield pa.RecordBatch.from_arrays([pa.array(flags, pa.int32()), pa.array(terms, pa.string())], ["toxic", "term"])


def _rows_of(batch: pa.RecordBatch, most: int = 200) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``most`` rows."""
    return (batch.slice(at, most) for at in range(0, len(batch), most))


def learn_terms(sample: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and stems that toxic rows have and clean ones hardly have, of at least four letters.

    A term stands in at least ``LEAST_ROWS`` toxic rows, ``LEAST_LIFT`` times as often as in clean
    ones, and with so many tests chance alone would leave less than one. No share of all toxic rows
    is asked for, so a language with few of them has its terms as well. A stem is the beginning of
    ``LEAST_FORMS`` words in toxic rows, none of which makes up more than half of its rows; of stems
    that begin with each other the most telling one stays, and words that it covers are left out.
    """
    counts = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = counts[0] or 0, counts[1] - (counts[0] or 0)
    if not toxic or not clean:
        return (), ()
    rows = sample.select(
        "toxic", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("words")
    )

    def counted(table: DataFrame) -> DataFrame:
        return table.groupBy("term").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).where(f"pos >= {LEAST_ROWS}")

    def told(table: DataFrame) -> dict[str, float]:
        tested = table.count()
        lift = (F.col("pos") / toxic) / ((F.col("n") - F.col("pos") + 0.5) / clean)
        strong = {r["term"]: _beyond_chance(r["pos"], r["n"], toxic / (toxic + clean), tested) for r in table.where(lift >= LEAST_LIFT).collect()}
        return {term: x for term, x in strong.items() if x > 0}

    words = told(settled(counted(rows.select("toxic", F.explode("words").alias("term")))))
    forms = rows.where("toxic = 1").select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("pos"))
    length = F.explode(F.sequence(F.lit(SHORT_STEM), F.least(F.char_length("word"), F.lit(LONG_STEM)))).alias("k")
    spread = forms.select("pos", "word", length).groupBy(F.substring("word", F.lit(1), F.col("k")).alias("term")).agg(
        F.count(F.lit(1)).alias("forms"), F.max("pos").alias("most")
    ).where(f"forms >= {LEAST_FORMS}")
    begins = counted(rows.mapInArrow(_begun, "toxic int, term string"))
    begins = settled(begins.join(spread, "term").where("2 * most <= pos"))
    stems: set[str] = set()
    taken: set[str] = set()  # beginnings of stems
    for stem, _ in sorted(told(begins).items(), key=lambda x: (-x[1], x[0])):
        shorter = {stem[:k] for k in range(SHORT_STEM, len(stem) + 1)}
        if stem not in taken and stems.isdisjoint(shorter):
            stems.add(stem)
            taken |= shorter
    plain = {w for w in words if stems.isdisjoint(w[:k] for k in range(SHORT_STEM, LONG_STEM + 1))}
    return tuple(sorted(plain)), tuple(sorted(stems))


def own_words(hits: DataFrame, toxic: int, clean: int) -> tuple[str, ...]:
    """Spellings near the lexicon whose share of clean rows is not far below that of toxic ones.

    Only hits that are not quoted count, once a row.
    """
    near = F.filter("hits", lambda h: (h["distance"] > 0) & ~h["quoted"])
    rows = hits.select("toxic", F.explode(F.array_distinct(F.transform(near, lambda h: h["surface"]))).alias("surface"))
    counts = rows.groupBy("surface").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).where("n > pos")
    own = counts.where(F.col("pos") * clean < OWN_LIFT * (F.col("n") - F.col("pos")) * toxic)
    return tuple(sorted(r["surface"] for r in own.collect()))


def features(hits: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Counts of hits per document, without fuzzy hits on ``words``."""
    known = F.array(*map(F.lit, words)).cast("array<string>")
    good = F.filter("hits", lambda h: (h["distance"] == 0) | ~F.array_contains(known, h["surface"]))
    hits = hits.withColumn("hits", good)

    def count(test) -> Column:
        return F.size(F.filter("hits", test)).cast("double")

    listed = F.array(*map(F.lit, INSULTS))
    exact = count(lambda h: (h["distance"] == 0) & ~h["quoted"] & F.array_contains(listed, h["term"]))
    fuzzy = count(lambda h: (h["distance"] > 0) & ~h["quoted"])
    learned = count(lambda h: (h["distance"] == 0) & ~h["quoted"] & ~F.array_contains(listed, h["term"]))
    return hits.withColumns(
        {
            "any_exact": (exact > 0).cast("double"), "more_exact": F.log1p(F.greatest(exact - 1, F.lit(0.0))),
            "any_fuzzy": (fuzzy > 0).cast("double"), "more_fuzzy": F.log1p(F.greatest(fuzzy - 1, F.lit(0.0))),
            "any_learned": (learned > 0).cast("double"), "more_learned": F.log1p(F.greatest(learned - 1, F.lit(0.0))),
            "quoted": F.log1p(count(lambda h: h["quoted"])),
            "direct": F.log1p(count(lambda h: h["direct"] & ~h["quoted"])),
        }
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, neighbouring words and weights from at most ``SAMPLE_ROWS`` labelled rows.

    The rows are those of smallest hash among the labelled rows of the training part. With labels
    of one kind only (or none) the score rests on exact hits alone.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = rated.where(in_training(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    chosen = settled(chosen)
    sample = settled(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))
    auto = build_automaton(INSULTS, *learn_terms(sample))
    hits = settled(find_hits(sample.select("doc_id", "text"), auto).join(F.broadcast(chosen), "doc_id"))
    toxic, clean = (hits.where(F.col("toxic") == k).count() for k in (1, 0))
    words = own_words(hits, toxic, clean)
    if not toxic or not clean:
        return Model(auto, words, tuple(4.0 if f == "any_exact" else 0.0 for f in FEATURES), -2.0)
    table = features(hits, words).select(
        array_to_vector(F.array(*FEATURES)).alias("features"), F.col("toxic").cast("double").alias("label")
    )
    fitted = LogisticRegression(maxIter=100, regParam=1e-3).fit(settled(table))
    return Model(auto, words, tuple(map(float, fitted.coefficients)), float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` from 0 to 1, ``predicted`` (1 from 0.5 on) and the ``hits``.

    A NULL or empty text has no hits and the score of the model's intercept. Rows with a NULL
    doc_id stay out; rows that repeat a doc_id are scored one by one. Extra columns are ignored.
    """
    table = features(find_hits(documents_of(docs), model.auto), model.words)
    total = F.lit(model.intercept)
    for name, weight in zip(FEATURES, model.weights):
        total = total + F.col(name) * F.lit(weight)
    out = table.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of the training part, then score every document."""
    return score(docs, fit(documents_of(docs), labels))

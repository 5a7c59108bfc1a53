import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import passages
from tidemark.llm.passages import compact_windows, repeated_passages


def test_each_subsequence_is_in_one_window():
    values = np.random.default_rng(0).integers(0, 40, 120)
    found = compact_windows(values, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            own = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(own) == 1 and values[i : j + 1].min() == values[own[0][1]]
    assert len(found) <= 2 * 120 / 10
    assert compact_windows(values[:9], 10) == [] == compact_windows(values[:0], 1)


def corpus(seed, n=150, edits=0):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(800)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(51, 90))] for _ in range(10)]
    rows, planted = {}, set()
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            passage = list(shared[i % 10])
            for _ in range(edits):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = passage
            planted.add(i)
        rows[i] = " ".join(words)
    return rows, planted


def test_exact_passages_are_all_found_and_nothing_else(docs):
    rows, planted = corpus(1)
    grams = defaultdict(set)
    for i, t in rows.items():
        w = t.split()
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    want = {i for held in grams.values() if len(held) > 1 for i in held}
    out = repeated_passages(docs(rows)).collect()
    assert {r["doc_id"] for r in out} == want == planted
    for r in out:
        a, b = rows[r["doc_id"]].split(), rows[r["rep_id"]].split()
        a, b = a[r["start"] : r["stop"]], b[r["rep_start"] : r["rep_stop"]]
        assert len(a) >= 45  # 41 of 46 runs of five words
        x, y = ({tuple(s[k : k + 5]) for k in range(len(s) - 4)} for s in (a, b))
        assert len(x & y) >= 0.7 * len(x | y)


def resembling(rows):
    """Documents with a run of 46 five-word runs of which another document has enough, by definition."""
    tokens = {}
    for i, t in rows.items():
        w = t.split()
        tokens[i] = np.array([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)], np.int64)
    out = set()
    for i, a in tokens.items():
        for j, b in tokens.items():
            if j < i and passages._flagged(a, b).any() and passages._flagged(b, a).any():
                out |= {i, j}
    return out


def test_recall_of_edited_passages(docs):
    rows, planted = corpus(2, edits=1)
    want = resembling(rows)
    found = {r["doc_id"] for r in repeated_passages(docs(rows)).collect()}
    assert found <= planted and want <= planted
    assert len(found & want) >= 0.9 * len(want) > 20


def hidden(layout, pairs, others, seed=9):
    """Passages of two documents each, most of whose words many others have as well.

    Rows with shuffled ids, and per passage its words and the two ids. ``layout`` has the lengths of its
    own and common parts in turn, or 'form': sixty common words with four slots filled per passage.
    """
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), 2 * pairs + others)
    word = lambda: f"w{rng.randrange(50_000)}"
    common = [word() for _ in range(60)]
    rows, planted = {}, []

    def text(middle):
        return " ".join([word() for _ in range(80)] + middle + [word() for _ in range(80)])

    for k in range(pairs):
        if layout == "form":
            passage = list(common)
            for slot in (7, 22, 37, 52):
                passage[slot] = word()
        else:
            before, shared, after = layout
            passage = [word() for _ in range(before)] + common[:shared] + [word() for _ in range(after)]
        own = ids[2 * k], ids[2 * k + 1]
        planted.append((len(passage), own))
        for i in own:
            rows[i] = text(passage)
    for i in ids[2 * pairs :]:
        part = [word() if layout == "form" and k in (7, 22, 37, 52) else w for k, w in enumerate(common)]
        rows[i] = text(part if layout == "form" else common[: layout[1]])
    return rows, planted


@pytest.mark.parametrize("layout", [(0, 40, 10), (0, 40, 15), (0, 40, 20), (0, 45, 10), (8, 44, 8), "form"])
def test_passages_whose_common_part_many_others_hold(docs, layout):
    rows, planted = hidden(layout, 40, 150)
    spans = defaultdict(list)
    for r in repeated_passages(docs(rows)).collect():
        spans[r["doc_id"]].append((r["start"], r["stop"]))
    whole = sum(
        all(any(a <= 80 and b >= 80 + n for a, b in spans[i]) for i in own) for n, own in planted
    )
    assert whole >= 0.9 * len(planted)


def test_doc_ids_with_several_texts(docs):
    """One text of document 2 is a copy, the other shares sixty words with document 3."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(50_000)}"
    copied, shared = (" ".join(word() for _ in range(n)) for n in (90, 60))
    rows = [(1, copied), (2, copied), (2, "x y " + shared), (3, shared + " z"), (3, "short"), (3, "short"), (4, " ".join(word() for _ in range(90)))]
    out = {tuple(r) for r in repeated_passages(docs(rows)).collect()}
    assert {(1, 0, 90, 1, 0, 90), (2, 0, 90, 1, 0, 90)} <= out
    assert {(2, 2, 62), (3, 0, 60)} <= {r[:3] for r in out} and {r[0] for r in out} == {1, 2, 3}


def test_copies_are_members_of_one_class(docs, monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(120))
    rows = {i: text for i in (4, 9, 7)} | {12: "own words " + text, 20: "short"}
    for bound in (10**6, 0):
        monkeypatch.setattr(passages, "BROADCAST_DOCS", bound)
        out = {tuple(r) for r in repeated_passages(docs(rows)).collect()}
        assert {(i, 0, 120, 4, 0, 120) for i in (4, 7, 9)} <= out
        assert (12, 2, 122, 4, 0, 120) in out and {r[0] for r in out} == {4, 7, 9, 12}


def test_awkward_rows(awkward, empty):
    out = {r["doc_id"] for r in repeated_passages(awkward).collect()}
    assert out == set()
    assert repeated_passages(empty).count() == 0


@pytest.mark.parametrize("layout", [(0, 49, 1), (1, 49, 0), (0, 47, 3), (1, 48, 1)])
def test_no_shared_run_is_lost_among_common_ones(docs, layout):
    """All but a word or three of each passage is held by 150 others: every run of 50 words counts."""
    rows, _ = hidden(layout, 40, 150)
    spans = defaultdict(list)
    for r in repeated_passages(docs(rows)).collect():
        spans[r["doc_id"]].append((r["start"], r["stop"], r["rep_id"]))
    holders = defaultdict(set)
    for i, t in rows.items():
        w = t.split()
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add((i, k))
    shared = [at for at in holders.values() if len({i for i, _ in at}) > 1]
    assert len(shared) >= 40
    for at in shared:
        reps = [{rep for a, b, rep in spans[i] if a <= k and k + 50 <= b} for i, k in at]
        assert set.intersection(*reps)


def test_run_hashes_tell_runs_by_content():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 500).astype(np.uint64)
    got = passages._run_hashes(tokens, 5)
    want = [tuple(tokens[k : k + 5]) for k in range(496)]
    assert len(got) == 496 and len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
    assert len(passages._run_hashes(tokens[:4], 5)) == 0


def test_seeded_windows_come_out_whoever_is_cut_where():
    """Groups of one document stay in, those of two come out whole, however rows fall into batches."""
    import pyarrow as pa

    f = passages.FUNCTIONS
    rows = [(1, 5, 0), (1, 5, 9), (2, 5, 0), (2, 5, 7), (2, 6, 1), (3, 8, 4), (3, 8, 4), (3, 9, 6)]
    want = sorted((d, c) for v, d, c in rows if v == 2)
    names = ["value", "doc", "c", "l", "r", "f"]
    table = [[v for v, *_ in rows], [d for _, d, _ in rows], *[[c for *_, c in rows]] * 3, [f] * len(rows)]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(table, types)], names)
    want += [(d, c) for v, d, c in rows if v == 3]
    for size in (1, 2, 3, 8):
        cut = [batch.slice(k, size) for k in range(0, len(rows), size)]
        out = [x for b in passages._paired(True)(iter(cut)) for x in b.to_pylist()]
        assert all(x["doc"] == x["pivot"] for x in out)
        assert sorted((x["doc"], x["c"]) for x in out) == sorted(want), size


def test_windows_of_texts_side_by_side():
    """Texts in one array have the windows that each has alone, bounds by definition."""
    rng = np.random.default_rng(5)
    for kinds in (2, 9, 10**9):
        texts = [rng.integers(0, kinds, n).astype(np.uint64) for n in (0, 70, 9, 10, 0, 45, 1, 130)]
        first = np.cumsum([0, *map(len, texts)])
        got = sorted(zip(*(x.tolist() for x in passages.block_windows(np.concatenate(texts), first, 10))))
        want = []
        for k, v in enumerate(texts):
            for c in range(len(v)):
                l = max([i + 1 for i in range(c) if v[i] <= v[c]], default=0)
                r = min([i - 1 for i in range(c + 1, len(v)) if v[i] < v[c]], default=len(v) - 1)
                want += [(k, l, c, r)] * (r - l + 1 >= 10)
        assert got == sorted(want)


def test_verified_spans_by_definition():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = []
    for k in range(60):
        own, other = (rng.integers(0, 10 ** (1 + 8 * (k % 2)), rng.integers(0, 300)).astype(np.uint32) for _ in range(2))
        n = min(len(own), len(other))
        if k % 3 and n > 60:
            other[5 : n - 5] = own[5 : n - 5]
            other[rng.integers(0, n, 3)] = 7
        rows.append((k, 1000 + k, 10 * k, own.tobytes(), 3 * k, other.tobytes()))
    want = []
    for doc, pivot, lo, own, other_lo, other in rows:
        own, other = (np.frombuffer(x, np.uint32) for x in (own, other))
        flags = np.concatenate([[0], passages._flagged(own, other), [0]])
        for a, b in np.flatnonzero(np.diff(flags)).reshape(-1, 2):
            here, there = np.flatnonzero(np.isin(own[a:b], other)) + a, np.flatnonzero(np.isin(other, own[a:b]))
            want.append((doc, lo + here[0], lo + here[-1] + 5, pivot, other_lo + there[0], other_lo + there[-1] + 5))
    types = dict(doc=pa.int64(), pivot=pa.int64(), lo=pa.int32(), own=pa.binary(), other_lo=pa.int32(), other=pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), types.values())], list(types))
    for cut in ([batch], [batch.slice(k, 7) for k in range(0, 60, 7)]):
        got = [tuple(x.values()) for b in passages._verify(iter(cut)) for x in b.to_pylist()]
        assert got == want and len(want) > 20


def test_texts_and_token_lists_stay_where_they_are(docs, spark, monkeypatch):
    """Whatever Spark would broadcast by itself, windows are made without moving texts, pairs compared by moving slices."""
    import io
    from contextlib import redirect_stdout

    plans = {"windows": [], "compared": []}

    def plan(df):
        with redirect_stdout(out := io.StringIO()):
            df.explain()
        return out.getvalue()

    make, compare = passages.windows, passages._compared
    monkeypatch.setattr(passages, "windows", lambda d: plans["windows"].append(plan(d)) or make(d))
    monkeypatch.setattr(passages, "_compared", lambda *a: (plans["compared"].append(plan(out := compare(*a))), out)[1])
    rows, planted = corpus(7)
    rows |= {1000 + k: rows[k] for k in range(0, 30, 3)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["doc_id"] for r in repeated_passages(docs(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert planted <= found
    assert len(plans["windows"]) == 1 and "Exchange hashpartitioning" not in plans["windows"][0]
    assert len(plans["compared"]) == 3
    for p in plans["compared"]:
        assert p.count("Exchange hashpartitioning") == 2  # pairs by document, slices by the other one


def test_pairs_that_look_up_one_document(docs, monkeypatch):
    """One text is the first holder for all others: its tokens go to their tasks."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50_000)}"
    common = [word() for _ in range(60)]
    rows = {i: " ".join([word() for _ in range(i % 7)] + common + [word()]) for i in range(40)}
    out = []
    for most in (passages.HEAVY, 0):
        monkeypatch.setattr(passages, "HEAVY", most)
        out.append({tuple(r) for r in repeated_passages(docs(rows)).collect()})
    assert out[0] == out[1] and {r[0] for r in out[0]} == set(range(40))


@pytest.mark.parametrize("kind", ["changed", "put in", "left out", "phrase", "short"])
def test_edited_passages_that_only_one_other_text_has(docs, kind):
    """Both sides of an edit stand in 60 others each, the whole in two texts alone: every pair counts, whoever comes first."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(50_000)}"
    left, right = ([word() for _ in range(26)] for _ in range(2))
    pairs = 12
    ids = rng.sample(range(10_000), 2 * pairs + 120)
    rows, planted = {}, {}
    text = lambda middle: " ".join([word() for _ in range(30)] + middle + [word() for _ in range(30)])
    for k in range(pairs):
        # Between 26 equal words and a part of 24 that the two alone have, so that none of the others is like them.
        own = [word() for _ in range(24)] if kind != "short" else [word()]
        one, other = (left + [word()], left + [word()]) if kind == "changed" else (left + ([word()] if kind == "put in" else []), list(left))
        if kind == "left out":
            one, other = list(left), left + [word()]
        if kind == "phrase":
            one, other = list(left), left + [word(), word(), word()]
        if kind == "short":  # 45 equal words: one side of the edit alone is enough
            one, other = ([*left, *right][:44], [*left, *right][:44])
        for i, middle in zip(ids[2 * k : 2 * k + 2], (one, other)):
            rows[i] = text(middle + own)
            planted[i] = ids[2 * k : 2 * k + 2]
    for k, i in enumerate(ids[2 * pairs :]):
        rows[i] = text([*left, *right][:40] if kind == "short" else left if k % 2 else right)
    # A phrase between the sides costs the text that has it too many tokens, and the other one no more than a word does.
    want = resembling(rows) if kind != "phrase" else set(planted)
    found = defaultdict(set)
    for r in repeated_passages(docs(rows)).collect():
        found[r["doc_id"]].add(r["rep_id"])
    assert set(planted) <= want and set(found) == want
    if kind != "short":
        assert all(found[i] & set(own) for i, own in planted.items())


def test_one_edit_among_many_holders_by_brute_force(docs):
    """Forms whose parts many texts have in turn: found are all that resemble another one, and no others."""
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(50_000)]
    form = [rng.choice(vocab) for _ in range(120)]
    rows = {}
    for i in range(220):
        a = rng.randrange(0, 75)
        words = form[a : a + rng.randint(38, 58)]
        for _ in range(rng.choice((0, 1, 1, 2))):
            at = rng.randrange(len(words))
            words[at : at + rng.choice((0, 1, 1))] = [rng.choice(vocab)] * rng.choice((0, 1, 1))
        rows[i] = " ".join([rng.choice(vocab) for _ in range(25)] + words + [rng.choice(vocab) for _ in range(25)])
    tokens = {}
    for i, t in rows.items():
        w = t.split()
        tokens[i] = np.array([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)], np.int64)
    want = {(i, int(k)) for i, a in tokens.items() for j, b in tokens.items() if i != j for k in np.flatnonzero(passages._flagged(a, b) & np.isin(a, b))}
    spans = defaultdict(list)
    for r in repeated_passages(docs(rows)).collect():
        spans[r["doc_id"]].append((r["start"], r["stop"]))
    missed = {(i, k) for i, k in want if not any(a <= k and k + 5 <= b for a, b in spans[i])}
    assert len({i for i, _ in want}) > 60 and not missed
    assert {i for i, x in spans.items() if x} <= {j for i, a in tokens.items() for j, b in tokens.items() if i != j and (passages._flagged(a, b).any() or passages._flagged(b, a).any())}


def test_samples_depend_on_their_tokens_alone():
    """Texts side by side, alone or as parts of others: every run of SEED tokens has the sample of its least hash."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, kinds, n).astype(np.uint64) for kinds in (2, 10**9) for n in (0, 46, 45, 200, 90)]
    first = np.cumsum([0, *map(len, texts)])
    at, key = passages._samples(np.concatenate(texts), first)
    got = sorted(zip(at.tolist(), key.tolist()))
    want = set()
    for a, t in zip(first, texts):
        runs = passages._run_hashes(t, passages.GRAM)
        for k in range(len(t) - passages.SEED + 1 if len(t) >= passages.LEAST else 0):
            part = runs[k : k + passages.SEED - passages.GRAM + 1]
            want |= {(int(a) + k + int(j), int(part.min())) for j in np.flatnonzero(part == part.min())}
    assert got == sorted(want)

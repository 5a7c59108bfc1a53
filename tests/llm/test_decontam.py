import random
import re

import pytest

from tidemark.llm import decontam
from tidemark.llm.decontam import MASKS, SAME, WINDOW, contaminated


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for (i, text), (j, item) in ((d, b) for d in docs for b in items):
        a, b = words(text), words(item)
        if i is None or j is None or not b:
            continue
        best = None
        for shift in range(-len(b), len(a)):
            seeded = any(
                all(0 <= p + shift + k < len(a) and p + k < len(b) and a[p + shift + k] == b[p + k] for k, bit in enumerate(m) if bit == "1")
                for m in MASKS for p in range(len(b))
            )
            if not seeded:
                continue
            same = {p: a[p + shift] == b[p] for p in range(len(b)) if 0 <= p + shift < len(a)}
            wide = min(WINDOW, len(b))
            ok = [p for p in same if all(p + k in same for k in range(wide)) and sum(same[p + k] for k in range(wide)) * WINDOW >= wide * SAME]
            if ok:
                lo, hi = min(ok), max(ok) + wide
                best = max(best or (-1,), (sum(same[p] for p in range(lo, hi)), lo - hi, -(lo + shift), lo + shift, hi + shift))
        if best:
            out[i, j] = (best[3], best[4], best[4] - best[3], best[0])
    return out


def got(df):
    rows = df.collect()
    out = {(r["doc_id"], r["item_id"]): (r["start"], r["stop"], r["n_words"], r["n_equal"]) for r in rows}
    assert len(out) == len(rows)
    return out


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 7, 12, 20, 40])))) for k in range(12)]
    docs = []
    for i in range(60):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if i % 2:
            passage = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 1, 2, 5])):
                passage[rng.randrange(len(passage))] = "changed"
            lo = rng.randint(0, len(passage) // 3)
            at = rng.randint(0, len(text))
            text[at:at] = passage[lo:]
        docs.append((i, ", ".join(text).title()))
    return docs, items


@pytest.mark.parametrize("bound", [0, 10**6])
def test_equals_brute_force(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", bound)
    monkeypatch.setattr(decontam, "BROADCAST_DOCS", bound)
    texts, items = cases(1)
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    out = got(contaminated(docs(texts), table))
    assert out == brute(texts, items) and len(out) > 10


def test_awkward_rows(spark, awkward, empty):
    from tests.llm.conftest import AWKWARD

    items = [(1, "word " * 30), (1, "word " * 30), (2, None), (None, "word word"), (3, ""), (4, "x" * 50_000)]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = got(contaminated(awkward, table))
    assert set(out) == {(5, 1)} and out[5, 1][3] == 30
    assert len(AWKWARD) == awkward.count()
    assert contaminated(empty, table).count() == 0
    assert contaminated(awkward, table.limit(0)).count() == 0

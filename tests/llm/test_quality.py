import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD
from tidemark.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (
        sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines), len(lines) - len(set(lines)), len(words), len(again)
    )


def counted(df):
    names = ("word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", "n_repeat_words")
    return sorted((r.doc_id, *[r[c] for c in names]) for r in quality.counts(df).collect())


def test_counts(docs, awkward, empty):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "bb", "c|", "#\n", "é😀", "\t", "x\x0b"], k=rng.randrange(60))) for _ in range(150)]
    texts += ["a b c a b c", "a a a a", "a b a b a", "a b c", "a b", "a b c d a b c d\na b c d a b c d\n", "\n\n x \n x \nx"]
    rows = list(enumerate(texts))
    assert counted(docs(rows)) == [(i, *plain_counts(t)) for i, t in rows]
    assert counted(awkward) == sorted((i, *plain_counts(t)) for i, t in AWKWARD if i is not None)
    assert quality.counts(empty).count() == 0


def at_most(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 2, 7, 50, 400, 1500) for k in range(0, n + 1, max(1, n // 40))]
    for p in (0.01, 0.3):
        df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_at_most(F.col("k"), F.col("n"), p).alias("v"))
        for r in df.collect():
            assert r.v == pytest.approx(at_most(r.k, r.n, p) if r.k < r.n * p else 1.0, rel=1e-9, abs=1e-300)
    # Large numbers against the normal approximation, five deviations below the mean.
    n, p = 10**9, 0.01
    k = int(n * p - 5 * math.sqrt(n * p * (1 - p)))
    v = spark.range(1).select(quality.binomial_at_most(F.lit(k), F.lit(n), p).alias("v")).first().v
    assert v == pytest.approx(0.5 * math.erfc(5 / math.sqrt(2)), rel=0.02)


def world(seed, n, langs=("en", "de")):
    """Good texts with few symbols, poor ones with many; some overlap."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        rate = rng.betavariate(1, 30) if good else rng.betavariate(4, 8)
        words = [("".join(rng.choices("abcdefgh", k=5)) + ("#" if rng.random() < rate else "")) for _ in range(rng.randrange(50, 90))]
        rows.append((i, " ".join(words), rng.choice(langs)))
        labels.append((i, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, lang string, blob string, stratum int")
    return docs, spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, rule int")


def plain_cutoffs(rows, labels, alpha, delta):
    """Per (lang, rule) the smallest cutoff that passes, by trying all of them."""
    good = {}
    for i, q in labels:
        good[i] = min(q, good.get(i, 1))
    texts = {}
    for i, t, lang in rows:
        c = plain_counts(t)
        if i in good and c[4] >= 50 and 100 * c[5] <= 50 * c[4]:
            texts[lang, t] = min(good[i], texts.get((lang, t), 1))
    strata = {k[0] for k in texts}
    out = {}
    for lang in strata:
        mine = [(plain_values(t), g) for (x, t), g in texts.items() if x == lang]
        n = sum(g for _, g in mine)
        poor = len(mine) - n
        for r, rule in enumerate(quality.RULES):
            for cut in sorted({v[r] for v, _ in mine}):
                k = sum(g for v, g in mine if v[r] > cut)
                if n and k < n * alpha / 5 and at_most(k, n, alpha / 5) <= delta / len(strata) / 5:
                    caught = sum(1 - g for v, g in mine if v[r] > cut)
                    if poor and caught >= quality.LIFT * alpha / 5 * poor:
                        out[lang, rule.name] = cut
                    break
    return out


def plain_values(text):
    chars, symbols, lines, dups, words, again = plain_counts(text)
    length = min(100 * chars / max(words, 1), 10000.0)
    share = lambda a, b: math.floor(quality.SCALE * a / b) if b else 0
    return (
        share(symbols, chars), share(dups, lines), share(again, words), math.floor(length), quality.SCALE - math.floor(length)
    )


def test_cutoffs_equal_the_plain_way(spark):
    rows, labels = world(5, 700, ("en", "en", "de", None))
    rows += [(10_000 + i, rows[0][1], rows[0][2]) for i in range(200)]  # copies are one observation
    labels += [(10_000 + i, labels[0][1]) for i in range(200)] + [(1, None), (None, 1), (2, 0), (99_999, 1)]
    docs, marks = frames(spark, rows, labels)
    c = quality.counts(docs, "lang").where(~quality.base_failed())
    got = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(c, marks, "lang", alpha=0.2, delta=0.1).collect()}
    wanted = plain_cutoffs(rows, [x for x in labels if None not in x], 0.2, 0.1)
    assert got == wanted and ("en", "symbols") in got
    out = {r.doc_id: r for r in quality.quality(docs, marks, alpha=0.2, delta=0.1).collect()}
    for i, t, lang in rows:
        failed = [r.name for r, v in zip(quality.RULES, plain_values(t)) if v > wanted.get((lang, r.name), math.inf)]
        assert (out[i].failed, out[i].kept) == (failed, not failed and not out[i].base_failed)


def test_false_rejections_stay_below_the_share(spark):
    """Cutoffs from one half of the world, false rejections counted on a large other half."""
    rows, labels = world(6, 2500, ("en",))
    fresh, truth = world(7, 2500, ("en",))
    docs, marks = frames(spark, rows + [(i + 50_000, t, lang) for i, t, lang in fresh], labels)
    out = {r.doc_id: r.kept for r in quality.quality(docs, marks).collect()}
    good = [i for i, q in truth if q]
    poor = [i for i, q in truth if not q]
    assert sum(not out[i + 50_000] for i in good) <= quality.ALPHA * len(good)
    assert sum(not out[i + 50_000] for i in poor) >= 0.5 * len(poor)


def test_awkward_tables(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality(awkward, none).collect()
    assert len(out) == sum(i is not None for i, _ in AWKWARD)
    assert not any(r.kept for r in out if (r.n_words or 0) < 50)
    assert quality.quality(empty, none).count() == 0
    few = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1)], "doc_id long, quality int")
    assert quality.quality(awkward, few).where("size(failed) > 0").count() == 0
    blob = hashlib.sha256(b"").hexdigest()
    assert {r.blob for r in out if r.doc_id in (1, 2)} == {blob}

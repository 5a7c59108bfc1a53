import itertools
import random

import numpy as np
import pytest

from tidemark.llm import toxicity as tx


def damerau(a, b):
    """Optimal string alignment distance."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def accepted(auto, word):
    state = 1
    for byte in word.encode():
        state = auto.table[state, auto.group[byte]]
    return (auto.terms[auto.term[state]], int(auto.distance[state])) if auto.term[state] >= 0 else None


def test_automaton_accepts_what_is_near_and_nothing_else():
    terms = ("scum", "idiot", "moron", "worthless", "disgusting", "motor")
    auto = tx.build_automaton(terms)
    rng = random.Random(3)
    words = list(terms)
    for term in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w) + 1)
                kind = rng.randrange(4)
                if kind == 0:
                    w.insert(k, rng.choice("abcdeimnorst"))
                elif kind == 1 and k < len(w) and len(w) > 1:
                    del w[k]
                elif kind == 2 and k < len(w):
                    w[k] = rng.choice("abcdeimnorst")
                elif kind == 3 and k + 1 < len(w):
                    w[k], w[k + 1] = w[k + 1], w[k]
            words.append("".join(w))
    for word in words:
        near = [damerau(word, t) for t in terms if damerau(word, t) <= tx.allowed(t)]
        found = accepted(auto, word)
        assert (found is not None) == bool(near), word
        if near:
            assert found[1] == min(near) == damerau(word, found[0])


def hits(spark, docs, rows):
    auto = tx.build_automaton(("idiot", "worthless", "scum"))
    table = tx.find_hits(tx.documents_of(docs(rows)), auto)
    return {r["doc_id"]: [h.asDict() for h in r["hits"]] for r in table.collect()}


def test_hits_places_and_context(spark, docs):
    got = hits(spark, docs, {
        1: "é you IDIOT!! and wrothless", 2: 'she said "you idiot" to him', 3: "an idio.t of scums", 4: "st idi0t",
    })
    assert [(h["start"], h["end"], h["term"], h["distance"]) for h in got[1]] == [(6, 11, "idiot", 0), (18, 27, "worthless", 1)]
    assert got[1][0]["direct"] and not got[1][0]["quoted"]
    assert got[2][0]["quoted"]
    assert [h["surface"] for h in got[3]] == ["idio"] and got[4][0]["distance"] == 1


def test_held_out_accuracy_and_misspellings(spark, docs):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(["the", "and", "of", "river", "stone", "sings", "motion"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(40), rng.choice(["idiot", "blorgface", "worthless", "wrothless"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = tx.toxicity(docs(rows), labels)
    held = out.where(~tx.in_training(out["doc_id"])).join(labels, "doc_id")
    assert held.where("predicted = toxic").count() >= 0.97 * held.count()
    assert held.count() > 200


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    rows = [(i, "idiot " * (i % 2) + "some plain words") for i in range(200)]
    table = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    flipped = table.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in tx.toxicity(docs(rows), t).collect()) for t in (table, flipped)]
    assert scores[0] == scores[1]


def test_terms_of_a_small_language_and_their_forms_are_learned(spark, docs):
    rng = random.Random(8)
    ends = ["le", "ment", "ou", "que", "ai", "oir", "ung", "ist", "am", "ers"]
    plain = ["le", "mot", "doux", "arbre", "pierre", "vent"]
    rows, labels = [], []
    for i in range(2000):
        kind = "own" if i % 40 == 0 else "en" if i % 5 == 1 else None
        words = [rng.choice(plain) for _ in range(30)]
        if kind == "own":  # a twentieth of the toxic rows, each with forms and a rare word
            words[3], words[9] = "réeux" + ends[i // 40 % 10], "drecko"
        elif kind == "en":
            words[3] = words[9] = "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind is not None)))
    rows += [(5000, "le mot drecko, réeuxle"), (5001, "le réeuxneu mot drekco"), (5002, "le mot doux")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    words, stems = tx.learn_terms(docs(rows).join(table, "doc_id"))
    assert words == ("drecko", "idiot") and stems == ("réeu",)
    out = {r["doc_id"]: r for r in tx.toxicity(docs(rows), table).collect()}
    own = [i for i in range(0, 2000, 40)]
    assert all(out[i]["predicted"] == 1 for i in own)
    assert {(h["surface"], h["term"], h["distance"]) for h in out[5001]["hits"]} == {("réeuxneu", "réeu*", 0), ("drekco", "drecko", 1)}
    assert out[5000]["predicted"] == 1 and out[5002]["predicted"] == 0 and not out[5002]["hits"]


def test_chance_alone_teaches_no_word(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{''.join(rng.choices('abcdefgh', k=3))}x" for _ in range(12))) for i in range(400)]
    table = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    assert tx.learn_terms(docs(rows).join(table, "doc_id")) == ((), ())


def test_one_clean_row_does_not_switch_a_spelling_off(spark, docs):
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        extra = ("idi0t" if i % 8 == 0 else "idiot") if toxic else ""
        if i in (1, 5, 9):  # a slip of the labels and two quotations
            extra = "idi0t" if i == 1 else 'he said "you stupidd" again'
        rows.append((i, f"some plain words {'mormon' if i % 3 == 0 else ''} {extra}"))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(tx.documents_of(docs(rows)), table)
    assert model.words == ("mormon",)
    out = {r["doc_id"]: r["predicted"] for r in tx.score(docs(rows), model).collect()}
    assert all(out[i] == 1 for i in range(0, 800, 8))


@pytest.mark.parametrize("rated", [[], [(4, 1)], [(None, 1), (1, None), (4, 0), (5, 1)]])
def test_awkward_rows(spark, awkward, empty, rated):
    labels = spark.createDataFrame(rated, "doc_id long, toxic int")
    rows = tx.toxicity(awkward, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.toxicity(empty, labels).count() == 0


def test_beginnings_of_words_give_back_what_a_worker_keeps():
    """Caches of an earlier stage would lie beside the fit's tables until the first text is scored."""
    import sys

    import pyarrow as pa

    from tidemark.llm import common

    common.per_worker(("pieces", 1), lambda: bytearray(1 << 20))
    words = [["idiots", "idiotic"], ["tree"]] * 250
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0] * 250, pa.int32()), pa.array(words)], ["toxic", "words"])
    parts = list(tx._begun(iter([batch])))
    assert not any(isinstance(k, tuple) for k in sys.modules["tidemark_worker"].__dict__)
    got = [(r["toxic"], r["term"]) for p in parts for r in p.to_pylist()]
    assert max(map(len, parts)) < len(got) and got.count((1, "idio")) == 250 == got.count((0, "tree"))
    assert set(got) == {(0, "tree"), *((1, t) for t in ("idio", "idiot", "idiots", "idioti", "idiotic"))}

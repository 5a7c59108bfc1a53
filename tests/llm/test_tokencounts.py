import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import tokencounts as tc
from tidemark.llm.queries import BYTE_BPE


def sums(spark, store):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in tc.totals(spark, store).collect()}


def plain(text):
    return {"blanks-1": len(re.findall(tc.BLANKS_1, text)), "words-2": len(re.findall(r"[^\W_]+|[^\w \t\n\x0b\f\r]|_", text))}


def test_batches_add_up_and_count_once(spark, docs, tmp_path):
    store = str(tmp_path)
    rows = {i: f"text {i}, with ünï words " * i for i in range(10)}
    every = tc.count_tokens(docs(rows))
    gone = tc.count_tokens(docs({i: rows[i] for i in (3, 4)}))
    revised = tc.count_tokens(docs({5: "shorter now"}))
    was = tc.count_tokens(docs({5: rows[5]}))
    assert sums(spark, store) == {}
    assert tc.apply_batch(store, "load", tc.changes(every, 1))
    assert tc.apply_batch(store, "del/1", tc.changes(gone, -1))
    edit = tc.changes(was, -1).unionByName(tc.changes(revised, 1))
    assert tc.apply_batch(store, "edit", edit)
    for batch in ("load", "del/1", "edit"):
        assert not tc.apply_batch(store, batch, tc.changes(every, 1))
    rows = {i: t for i, t in (rows | {5: "shorter now"}).items() if i not in (3, 4)}
    want = Counter()
    for t in rows.values():
        want.update(plain(t))
    assert sums(spark, store) == {("s", "en", v): (8, n) for v, n in want.items()}


def test_a_batch_that_broke_off_does_not_count(spark, docs, tmp_path):
    store = str(tmp_path)
    bad = docs({1: "x"}).select("source", "lang", F.lit("v").alias("version"), F.lit(1).alias("n_docs"), F.expr("raise_error('stop')").cast("long").alias("n_tokens"))
    with pytest.raises(Exception, match="stop"):
        tc.apply_batch(store, "load", bad)
    assert sums(spark, store) == {}
    assert tc.apply_batch(store, "load", tc.changes(tc.count_tokens(docs({1: "a b"})), 1))
    assert sums(spark, store)["s", "en", "blanks-1"] == (1, 2)


def test_deleting_everything_leaves_nothing(spark, docs, tmp_path):
    counts = tc.count_tokens(docs({1: "a b", 2: "c"}))
    tc.apply_batch(str(tmp_path), "a", tc.changes(counts, 1))
    tc.apply_batch(str(tmp_path), "b", tc.changes(counts, -1))
    assert sums(spark, str(tmp_path)) == {}


def test_counts_by_a_tokenizer_file(docs):
    texts = {1: "some words", 2: None, 3: "é 😀  x"}
    rows = tc.count_tokens(docs(texts), {"bpe": tc.file_counter(BYTE_BPE)}).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    assert {r["doc_id"]: r["counts"][0]["n_tokens"] for r in rows} == {i: len(library.encode(t or "").ids) for i, t in texts.items()}


def test_awkward_rows(spark, awkward, empty, tmp_path):
    from tests.llm.conftest import AWKWARD

    tc.apply_batch(str(tmp_path / "a"), "x", tc.changes(tc.count_tokens(awkward), 1))
    n = sum(plain(t or "")["blanks-1"] for _, t in AWKWARD)
    assert sums(spark, str(tmp_path / "a"))["s", "en", "blanks-1"] == (len(AWKWARD), n)
    tc.apply_batch(str(tmp_path / "b"), "x", tc.changes(tc.count_tokens(empty), 1))
    assert sums(spark, str(tmp_path / "b")) == {}

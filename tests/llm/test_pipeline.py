"""The stages on a small corpus, each against the operator's brute-force rule on its own input."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_linededup import brute as lines
from tests.llm.test_neardup import brute as groups
from tidemark.llm import toxicity as tx
from tidemark.llm.common import documents_of


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"word{k}" for k in range(400)]

    def prose(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [(k, " ".join(prose(30))) for k in range(5)]
    footer = "this footer line is long enough and stands in many documents"
    rows, labels = [], []
    for i in range(300):
        words = prose(60)
        kind = i % 10
        if kind == 0:
            words[7] = words[21] = "idiot"
        if kind == 1:
            words[10:10] = items[i // 10 % 5][1].split()
        text = " ".join(words) + ("\n" + footer if kind == 2 else "")
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(kind == 0)))
    for i in range(300, 330):  # near copies
        text = rows[i - 297][1].split()
        text[5] = "other"
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "lost", "en", "s", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_follow_their_rules(spark, sf_dir, tmp_path):
    docs, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), 0
    before = docs.where("doc_id IS NOT NULL")
    for name, stage in cp.STAGES:
        after = stage(spark, docs, sf_dir)
        after.write.parquet(f"{tmp_path}/out{n}")
        after, n = spark.read.parquet(f"{tmp_path}/out{n}"), n + 1
        rows = sorted(((r["doc_id"], r["text"]) for r in before.collect()), key=lambda r: r[0])
        if name != "sentencepiece":
            assert after.columns == list(cp.COLUMNS)
        if name == "toxicity":
            model = tx.fit(documents_of(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = {r["doc_id"] for r in tx.score(docs, model).where("predicted = 1").collect()}
            assert bad == set(range(0, 300, 10)) | {i for i, t in rows if t and "idiot" in t.split()}
            assert {r["doc_id"] for r in after.collect()} == {i for i, _ in rows} - bad
        elif name == "line_dedup":
            want = [(i, t) for i, t, _, gone in lines(rows, 40, 5) if not gone or t.strip()]
            assert pairs(after) == want and want != [(i, t or "") for i, t in rows]
        elif name == "near_dedup":
            want = sorted(i for i, _, c in groups(rows, 5, 80) if i == c)
            assert sorted(r["doc_id"] for r in after.collect()) == want and len(want) < len(rows)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            want = {i for i, _ in rows} - {i for i, _ in leaks(rows, items)}
            assert {r["doc_id"] for r in after.collect()} == want and len(want) < len(rows)
        else:
            got = after.collect()
            assert {r["doc_id"] for r in got} == {i for i, _ in rows} and all(r["round_trip"] for r in got)
        docs = before = after
    got = sorted((r["doc_id"], r["sample"], r["n_pieces"]) for r in cp.run(spark, sf_dir).collect())
    assert got == sorted((r["doc_id"], r["sample"], r["n_pieces"]) for r in after.collect())


def test_empty_tables(spark, sf_dir, tmp_path):
    empty = f"{tmp_path}/empty"
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert cp.run(spark, empty).count() == 0

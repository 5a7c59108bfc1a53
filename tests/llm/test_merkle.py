import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD
from tidemark.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    """Root and per leaf its siblings (left, right) by level, over the whole list at once."""
    proofs, now, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(now) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            proofs[k].append(("".join(now[run:i]), "".join(now[i + 1 : run + 3])))
            at[k] = i // 3
        now = [digest(*now[i : i + 3]) for i in range(0, len(now), 3)]
    return now[0], proofs


def plain_manifest(rows):
    """{doc_id, leaf, subroot, root, proof} of (doc_id, source, lang, n_chars, text) rows, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], plain_leaf(row)))
    low = lambda x: (x is not None, x if x is not None else 0)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in order:
        groups[name].sort(key=lambda r: (low(r[0]), r[1]))
        trees[name] = plain_tree([r[1] for r in groups[name]])
    root, above = plain_tree([trees[name][0] for name in order])
    out = []
    for name, upper in zip(order, above):
        for (doc, leaf), proof in zip(groups[name], trees[name][1]):
            out.append((doc, leaf, trees[name][0], root, tuple(proof + upper)))
    return sorted(out, key=str)


def found(df):
    return sorted(
        [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in df.collect()], key=str
    )


def table(spark, rows):
    return spark.createDataFrame(
        [(i, s, lang, n, t, "x", 5) for i, s, lang, n, t in rows],
        "doc_id long, source string, lang string, n_chars long, text string, key string, pos int",
    )


@pytest.mark.parametrize("sizes", [[1], [3, 4], [243, 244, 700, 27, 10, 1, 2]])
def test_trees_of_any_size(spark, sizes):
    rows = [(k * 10_000 + i, f"s{k}", "en", i, f"text {i}\n") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert found(merkle.manifest(table(spark, rows))) == plain_manifest(rows)


def test_butterfly_of_any_width(spark, monkeypatch):
    """With blocks of one leaf every level is a round, so all shapes of the right edge occur."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 0)
    rows = [(100 * n + i, f"s{n:02}", "en", i, "t") for n in [*range(1, 20), 27, 28, 55, 82] for i in range(n)]
    assert found(merkle.manifest(table(spark, rows))) == plain_manifest(rows)


def test_many_groups_and_a_hot_one(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 20 + [f"g{k}" for k in range(40)] + ["é", "z", "Z", "😀", "", None]), "en", 1, "t") for i in range(800)]
    assert found(merkle.manifest(table(spark, rows))) == plain_manifest(rows)


def test_awkward_rows(spark, docs, awkward, empty):
    rows = [(i, "s", "en", 0, t) for i, t in AWKWARD]
    assert found(merkle.manifest(awkward)) == plain_manifest(rows)
    assert merkle.manifest(empty).count() == 0
    nulls = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "-", 2, ""), (1, None, None, 2, "-")]
    assert found(merkle.manifest(table(spark, nulls))) == plain_manifest(nulls)


def test_any_change_breaks_the_proof(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"a\nb{i}") for i in range(50)]
    others = [F.col(c) for c in merkle.COLUMNS[:-1]]
    df = table(spark, rows).withColumn("now", merkle.leaf_hash(*others, F.translate("text", "\n", "")))
    out = merkle.manifest(df, carry=("now",))
    leads = [merkle.folded(F.col(c), F.col("proof")) == F.col("root") for c in ("leaf", "now")]
    assert out.select(*leads).distinct().collect() == [(True, False)]

import hashlib
import random

import pytest

from tidemark.llm import ctph, ordered


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_likeness_is_edit_distance():
    rng = random.Random(2)
    pairs = [["".join(rng.choice("abc") for _ in range(rng.randint(7, 64))) for _ in range(2)] for _ in range(200)]
    got = ctph._alike([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), value in zip(pairs, got):
        run = any(a[i : i + 7] in b for i in range(len(a) - 6))
        assert abs(value - (2 * lcs(a, b) / (len(a) + len(b)) if run else 0)) < 1e-12


def test_fingerprint_is_a_function_of_the_text():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(97, 110) for _ in range(rng.choice([0, 1, 5, 300, 5000]))) for _ in range(60)]
    whole = ctph.fingerprint(texts)
    assert whole == [ctph.fingerprint([t])[0] for t in texts]
    for f in whole:
        level, one, two = f.split(":")
        assert len(one) <= ctph.LONGEST and len(two) <= len(one) + 1 and int(level) >= ctph.LOWEST


def test_edits_stay_near_and_strangers_do_not():
    rng = random.Random(4)

    def text():
        return bytes(rng.randrange(97, 123) for _ in range(6000))

    a, b = text(), text()
    edited = a[:3000] + b"an insertion" + a[3000:5900]
    x, y, z = ctph.fingerprint([a, edited, b])
    assert ctph.likeness([x, x, x], [x, y, z]).tolist()[0] == 1.0
    assert ctph.likeness([x], [y])[0] > 0.8 and ctph.likeness([x], [z])[0] == 0.0
    longer = ctph.fingerprint([a + a[:4000]])[0]  # another block size
    assert longer.split(":")[0] != "0" and ctph.likeness([x], [longer])[0] > 0.4


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_next_documents_across_parts(docs, monkeypatch, part_bytes):
    monkeypatch.setattr(ordered, "PART_BYTES", part_bytes)
    rng = random.Random(5)
    rows = [(i * 37 % 1009, "é" * (i % 3) + "".join(rng.choice("ab cd") for _ in range(rng.randint(0, 400)))) for i in range(120)]
    out = {r["doc_id"]: r for r in ctph.edited_with_next(docs(rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(out) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own, other, next_one = ctph.fingerprint([t.encode(), edited.encode(), after.encode()])
        row = out[i]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (row["n_chars"], row["fingerprint"], row["edited_fingerprint"]) == (len(t), own, other)
        assert row["near_edited"] == ctph.likeness([own], [other])[0]
        assert row["near_next"] == ctph.likeness([own], [next_one])[0]


def test_awkward_rows(awkward, empty, docs):
    rows = ctph.edited_with_next(awkward).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 4, 4, 5, 6, 7, 8]
    assert ctph.edited_with_next(empty).count() == 0
    assert [r["near_next"] for r in ctph.edited_with_next(docs({1: "alone in here"})).collect()] == [1.0]
    assert ctph.fingerprints(awkward).count() == 10


def test_near_column(spark):
    table = spark.createDataFrame([("2:ab:a", "2:ab:a"), ("2:ab:a", None)], "a string, b string")
    assert [r[0] for r in table.select(ctph.near("a", "b")).collect()] == [1.0, None]

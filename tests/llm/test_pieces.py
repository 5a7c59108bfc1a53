import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import pieces as P
from tidemark.llm.queries import PIECES

VOCABULARY = P.load_vocabulary(PIECES)


def segmentations(text):
    """All segmentations of a short text and their log probabilities."""
    whole = "▁" + text.replace(" ", "▁")
    ids = {t: i for i, t in enumerate(VOCABULARY.text) if t}
    out = []

    def go(at, done, weight):
        if at == len(whole):
            out.append((tuple(done), weight))
            return
        for size in range(1, 17):
            i = ids.get(whole[at : at + size])
            if at + size <= len(whole) and i is not None:
                go(at + size, [*done, i], weight + VOCABULARY.weight[i])
        if whole[at] not in ids:
            raw = [int(VOCABULARY.byte_ids[b]) for b in whole[at].encode()]
            go(at + 1, done + raw, weight - len(raw) * np.log(2 + len(VOCABULARY.text)))

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {s: np.exp(w - total) for s, w in out}


@pytest.mark.parametrize("text", ["the cat", "a\nb é𓀀x", "ing  in"])
def test_samples_follow_gumbel_top_k(text):
    p, n, k = segmentations(text), 6000, 3
    lat = P.Lattices(VOCABULARY)
    first, second, total = Counter(), Counter(), 0.0
    for row in P._sample_batch(lat, [text] * n, P.mix(np.arange(n, dtype=np.uint64) + np.uint64(5)), k):
        found = [tuple(P.ids_of(lat, e, np.array([len(e)]))[0].tolist()) for e, *_ in row]
        assert len(set(found)) == len(found) == min(k, len(p))
        values = [v for _, _, v, _ in row]
        assert values == sorted(values, reverse=True) and values[-1] >= row[0][3]
        for s, (_, log, _, kappa) in zip(found, row):
            assert abs(np.log(p[s]) - log) < 1e-9
            total += np.exp(log) / -np.expm1(-np.exp(log - kappa))
        first[found[0]] += 1
        second[found[1]] += 1
    for s in sorted(p, key=p.get)[-3:]:
        assert abs(first[s] / n - p[s]) < 0.025
        follow = sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s)
        assert abs(second[s] / n - follow) < 0.025
    assert abs(total / n - 1) < 0.02  # inverse inclusion weights are unbiased


def test_every_segmentation_of_a_short_text(docs):
    rows = P.sample_segmentations(docs({1: "cat"}), PIECES, samples=100).collect()
    assert {tuple(r["ids"]) for r in rows} == set(segmentations("cat"))
    assert all(r["inclusion"] == 1.0 for r in rows)


def test_cache_size_changes_nothing(docs, monkeypatch):
    texts = {i: f"some words number {i} in a text é" * (i % 5 + 1) for i in range(40)}
    one = sorted(map(tuple, P.sample_segmentations(docs(texts), PIECES).collect()))
    monkeypatch.setattr(P, "CACHE_NODES", 1)
    monkeypatch.setattr(P, "BLOCK", 3)
    two = sorted(map(tuple, P.sample_segmentations(docs(texts).repartition(3), PIECES).collect()))
    assert [r[:4] for r in one] == [r[:4] for r in two]
    assert np.allclose([r[4:7] for r in one], [r[4:7] for r in two])
    assert [r[:4] for r in one] != [r[:4] for r in map(tuple, sorted(P.sample_segmentations(docs(texts), PIECES, seed=1).collect()))]


def test_awkward_rows_decode_again(awkward, empty):
    from tests.llm.conftest import AWKWARD

    out = P.sample_segmentations(awkward, PIECES)
    rows = out.collect()
    assert all(r["round_trip"] for r in rows)
    back = {(r["doc_id"], r["text"]) for r in P.decode_pieces(out, PIECES).collect()}
    assert back == {(i, t or "") for i, t in AWKWARD if i is not None}
    assert [(r["n_pieces"], r["inclusion"]) for r in rows if r["doc_id"] == 1] == [(0, 1.0)]
    assert P.sample_segmentations(empty, PIECES).count() == 0


def test_decoding_agrees_with_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    decode = P.Decoder(VOCABULARY)
    for text in ["Hello  world\n\tfoo é x ", " a", "日本 😀"]:
        ids = np.array(model.encode(text))
        data, _ = decode(ids, np.array([len(ids)]))
        assert data.tobytes().decode() == text == model.decode(ids.tolist())


def test_units_are_words_with_the_blanks_before_them():
    rng = np.random.default_rng(3)
    texts = ["", " ", "\n", "a", "  word", "a  b\n\n c ", "é 日本 😀\t x", *("".join(rng.choice(list("ab  \n é"), 40)) for _ in range(200))]
    u = P.split_units(texts)
    found = u.texts(np.arange(len(u.start)))
    for k, t in enumerate(texts):
        wanted = re.findall("\n| *[^ \n]+| +", " " + t) if t else []
        assert found[u.first[k] : u.first[k + 1]] == wanted
    same = {}
    for text, h in zip(found, u.hash.tolist()):
        assert same.setdefault(text, h) == h
    assert len(set(same.values())) == len(same)


def test_a_text_that_does_not_come_back_says_so(docs):
    """The vocabulary writes blanks as U+2581, so one in a text becomes a blank."""
    rows = P.sample_segmentations(docs({1: "a\u2581b c", 2: "a b c"}), PIECES).collect()
    assert {r["doc_id"]: r["round_trip"] for r in rows} == {1: False, 2: True}


def test_units_that_came_once_are_known_in_their_batch_alone():
    """No entry is made and taken back for each of them; the second time one stays."""
    lat = P.Lattices(VOCABULARY)
    one, two = P.split_units(["rare words here"]), P.split_units(["rare words here", "and others"])
    with np.errstate(over="ignore", divide="ignore"):
        first = lat.nodes_of(one)
        assert len(first) == 3 and (first > 0).all() and not lat.start
        again = lat.nodes_of(two)
    assert set(lat.start) == set(one.hash.tolist()) and len(set(again.tolist())) == 5
    assert [lat.start[h] for h in one.hash.tolist()] == again[:3].tolist()


def test_code_points_outside_the_vocabulary_become_their_bytes():
    lat = P.Lattices(VOCABULARY)
    lat.id = np.array([5, -1 - 0x10FFFF, 6, -1 - 0x7F, -1 - 0x7FF, -1 - 0xFFFD, -1 - 0x10FFFF], np.int32)
    ids, counts = P.ids_of(lat, np.arange(7), np.array([2, 0, 5]))
    b = lat.vocabulary.byte_ids
    far, mid, low = (b[list(chr(c).encode())].tolist() for c in (0x10FFFF, 0xFFFD, 0x7FF))
    assert ids.tolist() == [5, *far, 6, b[0x7F], *low, *mid, *far] and counts.tolist() == [5, 0, 1 + 1 + 2 + 3 + 4]

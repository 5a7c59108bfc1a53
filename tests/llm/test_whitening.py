from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, h long, x int, weight int, scores string, component int"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2, 3, "s", 9) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, weight="one", most=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} from all vectors at once, in exact numbers where asked."""
    x = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in vectors}
    fit = list(x.values()) if weight == "count" else sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    y = np.array([[float(Fraction(v[k]) - Fraction(s[k], n)) for k in range(d)] for v in fit])
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    out = {}
    for c in range(min(most, d)):
        e, u = values[-1 - c], vecs[:, -1 - c]
        if e <= values[-1] * d * 1e-15:
            break
        for i, v in x.items():
            centred = np.array([float(Fraction(v[k]) - Fraction(s[k], n)) for k in range(d)])
            deviation = sum((n * v[k] - s[k]) ** 2 for k in range(d))
            out[i, c + 1] = (n, deviation, centred @ u / np.sqrt(e), e / np.trace(cov))
    return out


def compare(df, wanted):
    rows = {(r.vec_id, r.component): r for r in df.collect()}
    assert rows.keys() == wanted.keys()
    for c in {c for _, c in wanted}:
        ids = sorted(i for i, k in wanted if k == c)
        got, want = (np.array([f(i) for i in ids]) for f in (lambda i: rows[i, c].whitened, lambda i: wanted[i, c][2]))
        sign = np.sign(got @ want)
        np.testing.assert_allclose(got * sign, want, atol=1e-8)
    for k, (n, deviation, _, explained) in wanted.items():
        assert (rows[k].n, int(rows[k].deviation)) == (n, deviation)
        assert rows[k].explained == pytest.approx(explained, rel=1e-9)
        assert rows[k].identity_error < 1e-8


def vectors_of(n, d, seed=3, scale=1.0, shift=0.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) * scale + shift
    return [(i, v.astype(np.float32)) for i, v in enumerate(base)]


@pytest.mark.parametrize("weight", ["one", "count"])
def test_equals_the_plain_way(spark, weight):
    vectors = vectors_of(200, 6)
    copies = [(1000 + i, vectors[0][1]) for i in range(100)] + [(2000 + i, vectors[i % 7][1]) for i in range(30)]
    everything = vectors + copies
    compare(whitening.whiten(table(spark, everything), weight=weight), plain(everything, weight))


def test_far_from_zero_and_beyond_64_bits(spark):
    """A spread that is small against the mean keeps its digits; large numbers are summed as such."""
    far = vectors_of(80, 3, shift=50_000.0)
    compare(whitening.whiten(table(spark, far)), plain(far, most=3))
    huge = vectors_of(60, 3, scale=1e14)
    out = whitening.whiten(table(spark, huge))
    wanted = plain(huge, most=3)
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert got.keys() == wanted.keys()
    assert all(int(got[k].deviation) == w[1] for k, w in wanted.items() if w[1] < 10**38)


def test_fewer_directions_than_asked(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    out = whitening.whiten(table(spark, line))
    assert {r.component for r in out.select("component").distinct().collect()} == {1}
    compare(out, plain([(i, np.float32(v)) for i, v in line]))


def test_awkward_vectors(spark):
    good = vectors_of(20, 3)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 2.0]),
           (105, [1.0, 2.0]), (106, [-float("inf")] * 3)]
    compare(whitening.whiten(table(spark, good + bad)), plain(good))
    repeated = whitening.whiten(table(spark, good + good[:2] + [(None, good[3][1])]))
    assert repeated.where("vec_id = 0").count() == 2 * 3 and repeated.where("vec_id IS NULL").count() == 3
    assert repeated.first().n == 20
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, bad[:5])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, good), weight="none")

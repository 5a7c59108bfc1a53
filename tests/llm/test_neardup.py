import random
import re

import pytest

from tidemark.llm import neardup
from tidemark.llm.graph import components
from tidemark.llm.neardup import least_matches, near_duplicates


def shingles(text, size):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute(rows, size, percent):
    rows = [(i, shingles(t, size)) for i, t in rows if i is not None]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(rows))


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def variants(seed, groups=12, copies=6):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(2, 120))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((at, " ".join(words)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs, size, percent):
    rows = variants(size)
    assert got(near_duplicates(docs(rows), size, percent)) == brute(rows, size, percent)


def test_many_small_tiles_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_NODES", 4)
    monkeypatch.setattr(neardup, "APART", 1)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):  # one large group, with members that link to a few others or to none
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert got(near_duplicates(docs(rows), 3, 85)) == brute(rows, 3, 85)


def test_shuffled_join_beyond_the_bound(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_NODES", 0)
    rows = variants(9, groups=4)
    assert got(near_duplicates(docs(rows), 3, 85)) == brute(rows, 3, 85)


def test_awkward_rows(awkward, empty):
    from tests.llm.conftest import AWKWARD

    assert got(near_duplicates(awkward, 3, 85)) == brute(AWKWARD, 3, 85)
    assert near_duplicates(empty).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    need = least_matches(0.85, 1e-7)
    assert list(need) == sorted(need)
    assert all(m < 0.85 * n for m, n in zip(need, range(25, 126, 25)))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (700, 699)], "a long, b long")
    out = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert out == {**{i: 0 for i in range(101)}, 699: 699, 700: 699}
    assert components(edges.limit(0)).count() == 0

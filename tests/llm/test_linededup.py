import random
from collections import defaultdict

from tidemark.llm import linededup
from tidemark.llm.linededup import drop_repeated_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    rows = [(i, (t or "").split("\n")) for i, t in rows if i is not None]
    holders = defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    for i, lines in rows:
        for line in lines:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, lines in rows:
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def got(df):
    return sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())


def sample(seed):
    rng = random.Random(seed)
    pool = [f"{k} shared line number {k} " * 2 for k in range(30)] + ["short"] * 5
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(1, 9))]
        lines = [rng.choice([x, f"  {x}\t", x.upper()]) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_brute_force(docs):
    rows = sample(1)
    out = got(drop_repeated_lines(docs(rows)))
    assert out == brute(rows, 40, 5)
    assert any(r[3] for r in out)


def test_full_filters_stay_exact(docs, monkeypatch):
    monkeypatch.setattr(linededup, "MIN_BITS", 64)
    monkeypatch.setattr(linededup, "MAX_BITS", 64)
    rows = sample(2)
    assert got(drop_repeated_lines(docs(rows), 5, 3)) == brute(rows, 5, 3)


def test_suspects_are_what_repeats(spark, docs):
    rows = [(i, f"a line that only document {i} has, long enough") for i in range(400)]
    rows += [(1000 + i, "the line that all of these documents have in common") for i in range(9)]
    lines = docs(rows).selectExpr("array(xxhash64(text)) AS hashes").repartition(7)
    words = linededup.twice_seen(lines, 1 << 16)
    assert 1 <= sum(int(w).bit_count() for w in words) <= 3 * linededup.PROBES


def test_awkward_rows(awkward, empty):
    from tests.llm.conftest import AWKWARD

    assert got(drop_repeated_lines(awkward, 1, 2)) == brute(AWKWARD, 1, 2)
    assert drop_repeated_lines(empty).count() == 0


def test_carried_columns(awkward):
    assert drop_repeated_lines(awkward, carry=("lang", "node")).columns == ["doc_id", "lang", "node", "text", "n_lines", "n_dropped"]

"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import near_dedup
from quillspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, hash string, text2 string"


def brute(rows, percent=75):
    sets, root = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, base = [], words(140)
    for _ in range(60):  # copies of one text with few to many edits: some link only to each other
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    for _ in range(15):
        t = words(rng.randrange(5, 80))
        rows += [" ".join(t), " ".join(t).upper(), "  ".join(t[:-1]), " ".join(t[1:] + ["end"])]
    rows += [None, "", " \t\n", "one two", "One  TWO", "a b c d e", "\x0b", "x" * 5000, "x" * 5000, " ".join(words(20000))]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[j]) for i, j in enumerate(order)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "h", "t") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", None, None, None)] * 2 + [(None, "a b c d e f", None, None, None)], SCHEMA)
    assert [tuple(r) for r in near_dedup.near_duplicates(twice).collect()] == [(1, 2, 1, True)]
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(twice, bands=100)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    close = []
    for _ in range(40):
        shared, x, y = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        a, b = near_dedup.superminhash([np.unique(np.r_[shared, x]), np.unique(np.r_[shared, y])], 128)
        close.append((a == b).mean())
    assert abs(np.mean(close) - 0.6) < 0.03
    full = near_dedup.superminhash([np.arange(1, 4, dtype=np.uint64)], 128)
    assert (full < np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_words_between_ascii_space():
    column = pa.array(["A\x0bb\x0cc d e", None, "a b\tc\nd\re é"])
    (_, sets), = near_dedup.shingle_sets(column, 5)
    assert [len(s) for s in sets] == [1, 0, 2] and sets[0][0] in sets[2]

"""Components against all pairs, copies collapsed, with small buckets and with tiles."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tarnspark.llm import near_dedup as N
from tarnspark.llm.common import Scratch
from tarnspark.llm.components import components


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def corpus(seed):
    rng, out = random.Random(seed), []
    for _ in range(12):
        base = words(rng, rng.randint(40, 120)).split()
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            out.append(" ".join(w))
    return out + [out[0].upper(), out[1], "a b", "a b", "a  b", "A", "", None]


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("small,k,percent", [(32, 3, 85), (1, 3, 85), (32, 5, 80)])
def test_components(docs, monkeypatch, small, k, percent):
    monkeypatch.setattr(N, "SMALL", small)
    texts = corpus(small + k)
    want, sizes = brute(texts, k, percent)
    for r in N.near_duplicates(docs(texts, extra=True), k, percent).collect():
        assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_tile_links():
    a, b, c = (np.arange(i, i + 100) for i in (0, 5, 500))
    side = lambda *s: pd.DataFrame({"sig": [bytes([i]) for i, _ in s], "label": [bytes([i]) for i, _ in s], "items": [x for _, x in s]})
    got = N.tile_links(side((1, a), (3, c)), side((1, a), (2, b), (3, c)), 85)
    assert [tuple(x) for x in got.values] == [(b"\x01", b"\x02")]
    assert N.tile_links(side(), side((1, a)), 85).empty


def test_each_tile():
    """Tiles cut anywhere by batches, several in a batch, and one without a left side."""
    a, b, c = (np.arange(i, i + 100) for i in (0, 5, 500))
    rows = [(t, left, bytes([t, i]), bytes([t, i]), x) for t in (0, 3, 7) for left in ((False,) if t == 3 else (True, False)) for i, x in enumerate((a, b, c))]
    df = pd.DataFrame(rows, columns=["tile", "left", "sig", "label", "items"])
    want = {(bytes([t, 0]), bytes([t, 1])) for t in (0, 7)}
    for size in (1, 4, 100):
        got = pd.concat(N.each_tile((df.iloc[i : i + size] for i in range(0, len(df), size)), 85))
        assert {tuple(sorted(x)) for x in got.values} == want
    assert not [*N.each_tile(iter([df.iloc[:0]]), 85)]


def test_hubs(spark):
    """Components with a node of thousands of links, least or greatest of its component, beside chains."""
    low = [(0, i) for i in range(1, 2500)]
    high = [(9999, i) for i in range(3000, 5500)]
    chain = [(i, i + 1) for i in range(6000, 6040)]
    links = spark.createDataFrame([*low, *high, *chain, (7, 7), (1, 0)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links, "a", "b", Scratch(spark)).collect()}
    want = {i: 0 for i in range(2500)} | {i: 3000 for i in [*range(3000, 5500), 9999]} | {i: 6000 for i in range(6000, 6041)}
    assert got == want
    assert components(links.limit(0), "a", "b", Scratch(spark)).count() == 0


def test_distinct_documents(docs, odd, spark):
    df = docs(odd, extra=True)
    out = N.distinct_documents(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10]
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "u v w x y z", "s"), (None, "a b c d e f", "s")]
    assert sorted(r["text"] for r in N.distinct_documents(docs(rows)).collect()) == ["a b c d e f", "u v w x y z"]
    assert N.near_duplicates(df.limit(0)).count() == 0

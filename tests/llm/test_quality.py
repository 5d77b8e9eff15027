"""The label model on planted labellers, and the whole operator on clean and junk texts."""

import random
from collections import Counter

from tarnspark.llm import quality as Q


def texts(seed=1, n=240):
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8)))
    for i in range(n):
        words = [word() for _ in range(rng.randint(40, 120))]
        kind = i % 6
        if kind == 0:
            out.append((0, " ".join(f"{w}{rng.choice(['***', '%%%', '$$$'])}" for w in words)))
        elif kind == 1:
            out.append((0, "!! ".join(words).upper()))
        else:
            out.append((1, ". ".join(" ".join(words[j : j + 8]).capitalize() for j in range(0, len(words), 8)) + "."))
    return out


def code(votes):
    return sum(v * 3 ** (len(votes) - 1 - i) for i, v in enumerate(votes))


def test_planted_labellers_are_recovered():
    rng, k, n = random.Random(5), len(Q.LABELLERS), 60_000
    alarm = [0.3, 0.05, 0.001, 0.02, 0.0, 0.01, 0.1, 0.002, 0.004, 0.001, 0.2][:k]
    hit = [0.7, 0.6, 0.5, 0.9, 0.4, 0.5, 0.8, 0.6, 0.3, 0.7, 0.5][:k]
    counts, labels = Counter(), []
    for _ in range(n):
        bad = rng.random() < 0.15
        votes = [2 if rng.random() < 0.1 else int(rng.random() < (h if bad else a)) for a, h in zip(alarm, hit)]
        counts[code(votes)] += 1
        labels.append((code(votes), bad))
    good, rate = Q.estimate(counts)
    for i in range(k):
        assert abs(rate[0, i, 1] - alarm[i]) < 0.02 and abs(rate[1, i, 1] - hit[i]) < 0.03, i
    assert sum((good[c] < 0.5) == bad for c, bad in labels) / n > 0.97


def test_patterns_stand_for_documents():
    """EM document by document, in plain loops, gives the posteriors that EM over pattern counts gives."""
    rng, k = random.Random(6), len(Q.LABELLERS)
    docs = [[rng.choice([0, 0, 0, 0, 1, 2]) for _ in range(k)] for _ in range(300)]
    good, rate = Q.estimate(Counter(map(code, docs)), rounds=15)
    p = [Q.START[min(2, d.count(1))] for d in docs]
    for _ in range(15):
        r = {}
        for c, w in ((0, p), (1, [1 - x for x in p])):
            for i in range(k):
                seen = [Q.PSEUDO * (0.99 if c == 0 else 0.5), Q.PSEUDO * (0.01 if c == 0 else 0.5)]
                for x, d in zip(w, docs):
                    if d[i] < 2:
                        seen[d[i]] += x
                r[c, i] = [s / sum(seen) for s in seen]
        share = (sum(p) + Q.PSEUDO) / (len(docs) + 2 * Q.PSEUDO)
        new = []
        for d in docs:
            a, b = share, 1 - share
            for i, v in enumerate(d):
                if v < 2:
                    a, b = a * r[0, i][v], b * r[1, i][v]
            new.append(a / (a + b))
        p = new
    assert all(abs(good[code(d)] - x) < 1e-6 for d, x in zip(docs, p))
    assert abs(rate[0, 0, 1] - r[0, 0][1]) < 1e-9 and Q.estimate({})[0] == {} and Q.estimate({-1: 5})[0] == {}


def test_a_clean_source_that_trips_one_labeller():
    names = list(Q.LABELLERS)
    votes = lambda *bad: code([int(n in bad) for n in names])
    for n in (1000, 50_000):
        share = n // 100
        good, rate = Q.estimate({votes(): 60 * share, votes("sentences"): 33 * share, votes("symbols", "runs"): 3 * share, votes("echo", "variety"): 2 * share, votes("shouting", "exclaim"): 2 * share})
        assert good[votes("sentences")] > 0.9 and good[votes("symbols", "runs")] < 0.05
        assert abs(rate[0, names.index("sentences"), 1] - 33 / 93) < 0.02


def test_held_out_accuracy(docs):
    rows = texts()
    got = {r["doc_id"]: r for r in Q.scored(docs([t for _, t in rows], extra=True)).collect()}
    right = sum(got[i]["kept"] == bool(y) for i, (y, _) in enumerate(rows))
    assert right / len(rows) >= 0.97
    assert all(got[i]["kept"] for i, (y, _) in enumerate(rows) if y)


def test_edges(docs, odd):
    df = docs(odd + [t for _, t in texts(2, 60)], extra=True)
    got = {r["doc_id"]: r for r in Q.scored(df).collect()}
    assert all(got[i]["score"] == 0 and not got[i]["kept"] for i in (0, 1, 2))
    assert got[3]["score"] == got[4]["score"]
    out = Q.accepted(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {i for i, r in got.items() if r["kept"]}
    assert Q.scored(df.limit(0)).count() == 0

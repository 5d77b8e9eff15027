"""Neighbours against all distances, in tiles smaller than the table."""

import math

import numpy as np
from pyspark.sql import functions as F

from tarnspark.llm import knn


def brute(rows, k):
    v = [(i, [float(np.float32(x)) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    out = []
    for q in sorted({i for i, _ in v if i % 10 == 0}):
        a = next(e for i, e in v if i == q)
        d = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, e))), i) for i, e in v if i != q and len(e) == len(a))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d[:k])]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, rank string")


def test_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(900, None), (910, [0.0] * 24), (920, [float("nan")] * 24), (930, [None] * 24), (940, [float("inf")] + [1.0] * 23), (950, [1.0, 2.0]), (None, rows[1][1]), (311, rows[2][1])]
    df = table(spark, rows)
    got = sorted(map(tuple, knn.nearest(df, F.col("vec_id") % 10 == 0, 10, query_band=7, row_band=50).collect()))
    want = brute(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    got = knn.nearest(table(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert knn.nearest(table(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 1500))
    q, s, n, e = knn.quantised(x)
    near = np.sqrt(np.maximum(n[:, None] ** 2 + n[None] ** 2 - 2 * knn.product(q, q) * s[:, None] * s[None], 0))
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert (np.abs(near - true) <= e[:, None] + e[None] + 1e-6).all()

"""Op 4: exact nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into row and column bands; one task holds one tile of bounded size.
In a tile, vectors are int8 with a scale each, and one integer matrix product gives all inner
products. With norms it gives approximate distances, and the quantisation residuals bound the error:
|d(q, c) - d(q', c')| <= |q - q'| + |c - c'|. A candidate whose lower bound exceeds a query's k-th
least upper bound cannot be among its nearest in the tile; the others are recomputed in double
precision from the original vectors, dimension by dimension. The tiles' lists are merged by heaps.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors of another dimension than the query's; fewer candidates than k give them all; ties go to
the smaller vec_id; a row with the query's own vec_id is no candidate; repeated rows are candidates
of their own and repeated queries are answered once; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile's two sides: 4096 queries by 16384 candidates.
QUERY_BAND, ROW_BAND = 4096, 16_384
#: Columns compared at a time, so that a tile's product needs bounded memory.
SLICE = 2048
#: Products of int8 add up exactly in float32 below this many dimensions.
EXACT_DIMS = 1024
TOP = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and double components of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, norms of what they stand for, and norms of the residuals (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    back = q.astype(np.float64) * scale[:, None]
    return q, scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1)) * (1 + 1e-9)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of one vector to several in double precision, components added in order."""
    total = np.zeros(len(c))
    for d in range(len(q)):
        total += (q[d] - c[:, d]) ** 2
    return np.sqrt(total)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of the tile for each of its queries."""
    q8, qs, qn, qe = quantised(q)
    c8, cs, cn, ce = quantised(c)
    out = []
    for lo in range(0, len(qid), max(1, SLICE * 512 // max(1, len(cid)))):
        part = slice(lo, lo + max(1, SLICE * 512 // max(1, len(cid))))
        dot = product(q8[part], c8) * qs[part, None] * cs[None, :]
        near = np.sqrt(np.maximum(qn[part, None] ** 2 + cn[None, :] ** 2 - 2 * dot, 0))
        slack = qe[part, None] + ce[None, :] + 1e-7 * (1 + qn[part, None] + cn[None, :])
        low, high = near - slack, near + slack
        own = qid[part, None] == cid[None, :]
        low[own] = high[own] = np.inf
        kth = np.partition(high, k - 1, axis=1)[:, k - 1] if len(cid) > k else np.full(len(high), np.inf)
        for i in range(len(high)):
            at = np.flatnonzero((low[i] <= kth[i]) & ~own[i])
            d = exact(q[lo + i], c[at])
            for j in np.lexsort((cid[at], d))[:k]:
                out.append((qid[lo + i], cid[at[j]], d[j]))
    return out


def nearest(vectors: DataFrame, is_query, k: int = 10, query_band: int = QUERY_BAND, row_band: int = ROW_BAND) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query, nearest first."""
    v = usable(vectors)
    queries = v.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))  # of rows that share an id the least vector asks
    n, nq = v.count(), queries.count()
    cols, rows = max(1, math.ceil(n / row_band)), max(1, math.ceil(nq / query_band))
    # a row's band follows from its place in the input, so equal rows do not meet in one band
    c = v.withColumn("col", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cols))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    q = queries.withColumn("row", F.pmod(F.xxhash64("vec_id"), F.lit(rows))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ql, cl = left["v"].map(len).to_numpy(), right["v"].map(len).to_numpy()
            for dim in np.unique(ql):
                a, b = left[ql == dim], right[cl == dim]
                if len(b):
                    out += tile(a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Heaps of the k best of each query in this partition."""
        heaps: dict[int, list] = {}
        for pdf in batches:
            for qid, cid, s in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                h = heaps.setdefault(qid, [])
                item = (-s, -cid)
                if len(h) < k:
                    heapq.heappush(h, item)
                elif item > h[0]:
                    heapq.heapreplace(h, item)
        rows = [(qid, i + 1, -cid, -s) for qid, h in heaps.items() for i, (s, cid) in enumerate(sorted(h, reverse=True))]
        for i in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[i : i + 100_000], columns=["query_id", "rank", "vec_id", "score"])

    tiles = q.groupBy("row", "col").cogroup(c.groupBy("row", "col")).applyInPandas(compare, TOP)
    return tiles.repartition("query_id").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")

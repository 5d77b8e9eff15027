"""Op 10: quality classifier by a weak-label model.

Overlapping heuristic labellers vote on every document (bad, good or no vote); each defect that they know
is seen by at least two of them, by different signs. The votes of all documents are counted by pattern,
and expectation-maximisation over those counts estimates, without hand labels, how each labeller votes on
good and on bad documents and how common bad ones are. Rates have a prior of ``PSEUDO`` documents, a fixed
number. EM starts from agreement: two bad votes speak for a bad document, a single one does not; so a
labeller that many otherwise clean documents trip by itself gets the false-alarm rate it has, and a single
vote of it decides nothing.

The posterior of a document's pattern is its label. A linear scorer over hashed features, word shapes
and binned text statistics, is trained on a bounded sample of labelled rows (``SAMPLE``, the least by
hash) and then scores every whole text; documents scoring under ``THRESHOLD`` are rejected.

Driver side: at most 3 ** len(LABELLERS) pattern counts and the sample's feature rows; the model is
``DIMS`` weights.

Defined cases: null or wordless text gets score 0 and is rejected; a text that no labeller votes on
is scored by its features like any other; repeated rows get equal scores; an empty table gives no
rows; ``accepted`` keeps all columns, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnspark.llm.common import fresh, own_columns

DIMS = 4096
SAMPLE = 20_000
THRESHOLD = 0.5
ROUNDS = 60
#: Pseudo-documents of a vote rate's prior, and the good-or-bad guess that EM starts from by number of bad votes.
PSEUDO = 1.0
START = (0.99, 0.8, 0.02)
#: Words of a block in which variety is measured.
BLOCK = 50
GOOD, BAD, NONE = 0, 1, 2

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b" \t\n\r\x0b\x0c.,;:!?'\"()-"]] = True
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
#: The same mark three times or more.
_SAME = re.compile(rb"([!-/:-@\[-`{-~])\1\1+")


def statistics(text: str) -> tuple[dict[str, float], list[bytes]]:
    """Shares of a whole text, and its words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return {"words": 0.0}, words
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, solid = int(c[_LETTER].sum()), max(1, int(c.sum() - c[[*b" \t\n\r\x0b\x0c"]].sum()))
    ends = [x for x in (line.rstrip() for line in raw.split(b"\n")) if x]
    return {
        "words": float(n),
        "symbols": float(solid - letters - c[_DIGIT].sum() - (c[_PLAIN].sum() - c[[*b" \t\n\r\x0b\x0c"]].sum())) / solid,
        "upper": float(c[_UPPER].sum()) / max(1, letters),
        "letters": float(letters) / solid,
        "exclaim": float(c[33]) / n,
        "bars": float(c[124]) / n,
        "digits": float(c[_DIGIT].sum()) / solid,
        "length": solid / n,
        "runs": sum(len(m[0]) for m in _SAME.finditer(raw)) / solid,
        "variety": sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n,
        "echo": sum(a == b for a, b in zip(words, words[1:])) / n,
        "top": max(Counter(words).values()) / n,
        "stops": sum(x[-1:] in b".!?\"" for x in ends) / max(1, len(ends)),
    }, words


def between(x: float, good: float, bad: float) -> int:
    """Vote on a share of which little is good and much is bad."""
    return GOOD if x <= good else BAD if x >= bad else NONE


#: name -> vote; thresholds are round figures of common filtering practice.
LABELLERS = {
    "symbols": lambda s: between(s["symbols"], 0.02, 0.08),
    "shouting": lambda s: NONE if s["words"] < 5 else between(s["upper"], 0.15, 0.5),
    "exclaim": lambda s: NONE if s["words"] < 5 else between(s["exclaim"], 0.1, 0.3),
    "menu": lambda s: NONE if s["words"] < 5 else between(s["bars"], 0.02, 0.15),
    "echo": lambda s: NONE if s["words"] < 10 else between(s["echo"], 0.05, 0.25),
    "one_word": lambda s: NONE if s["words"] < 30 else between(s["top"], 0.15, 0.35),
    "runs": lambda s: between(s["runs"], 0.02, 0.1),
    "variety": lambda s: NONE if s["words"] < 20 else GOOD if s["variety"] >= 0.5 else BAD if s["variety"] <= 0.35 else NONE,
    "digits": lambda s: between(s["digits"], 0.1, 0.5),
    "word_length": lambda s: GOOD if 2.5 <= s["length"] <= 9 else BAD if s["length"] < 1.5 or s["length"] > 16 else NONE,
    "sentences": lambda s: NONE if s["words"] < 30 else GOOD if s["stops"] >= 0.6 else BAD if s["stops"] == 0 and s["words"] >= 100 else NONE,
}


def pattern(stats: dict[str, float]) -> int:
    """All votes as one number in base 3; -1 for a text without words."""
    if not stats["words"]:
        return -1
    code = 0
    for vote in LABELLERS.values():
        code = 3 * code + vote(stats)
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def estimate(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of "good" by pattern, and each labeller's vote rates by class, by expectation-maximisation.

    ``rate[c, l, v]`` is how often labeller l votes v (GOOD, BAD) on documents of class c, among those it
    votes on; no vote is no evidence.
    """
    codes = sorted(c for c in counts if c >= 0)
    if not codes:
        return {}, np.zeros((2, len(LABELLERS), 2))
    v = np.array([votes_of(c) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    one = np.eye(3)[v][:, :, :NONE]  # pattern, labeller, vote
    good = np.take(START, np.minimum((v == BAD).sum(axis=1), 2))
    for _ in range(rounds):
        w = np.stack([n * good, n * (1 - good)])
        rate = np.einsum("cp,plv->clv", w, one) + PSEUDO * np.array([[[0.99, 0.01]], [[0.5, 0.5]]])
        rate /= rate.sum(axis=2, keepdims=True)
        share = (w.sum(axis=1) + PSEUDO) / (w.sum() + 2 * PSEUDO)
        logp = np.log(share)[:, None] + np.einsum("clv,plv->cp", np.log(rate), one)
        good = 1 / (1 + np.exp(np.clip(logp[1] - logp[0], -50, 50)))
    return dict(zip(codes, good.tolist())), rate


_shapes: dict[bytes, int] = {}


def hashed(stats: dict[str, float], words: list[bytes]) -> tuple[list[int], list[float]]:
    """Indices and values: word shapes by root share, statistics as indicators of their bin."""
    if len(_shapes) > 500_000:
        _shapes.clear()
    for w in words:
        if w not in _shapes:
            _shapes[w] = xxhash.xxh32_intdigest(_RUN.sub(rb"\1\1", w.translate(_SHAPE))[:24]) % DIMS
    n = max(1, len(words))
    out = Counter({i: (c / n) ** 0.5 for i, c in Counter(map(_shapes.__getitem__, words)).items()})
    for name, x in stats.items():
        b = int(np.log2(x + 1)) if name in ("words", "length") else min(20, int(x * 20))
        out[xxhash.xxh32_intdigest(f"{name}={b}".encode()) % DIMS] += 0.5
    return list(out), list(out.values())


def train(rows: list[tuple[list[int], list[float], float]], steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full batches with a step of its own for each weight."""
    w, bias = np.zeros(DIMS), 0.0
    if not rows:
        return w, bias
    size = np.array([len(i) for i, _, _ in rows])
    doc = np.repeat(np.arange(len(rows)), size)
    at = np.concatenate([np.asarray(i, int) for i, _, _ in rows])
    x = np.concatenate([np.asarray(v, float) for _, v, _ in rows])
    y = np.array([p for _, _, p in rows])
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))  # both classes count alike
    seen, seen_bias = np.full(DIMS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(doc, w[at] * x, len(rows)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        g, gb = np.bincount(at, e[doc] * x, DIMS) + 1e-6 * w, e.sum()
        seen += g * g
        seen_bias += gb * gb
        w -= 0.5 * g / np.sqrt(seen)
        bias -= 0.5 * gb / np.sqrt(seen_bias)
    return w, bias


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias for this corpus."""

    @F.pandas_udf(T.IntegerType())
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series([pattern(statistics(t or "")[0]) for t in texts], dtype="int32")

    @F.pandas_udf("struct<code:int,at:array<int>,x:array<float>>")
    def features(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s, words = statistics(t or "")
            out.append((pattern(s), *hashed(s, words)))
        return pd.DataFrame(out, columns=["code", "at", "x"])

    counts = {r["code"]: r["n"] for r in docs.select(code("text").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, _ = estimate(counts)
    # the least by hash: a cut by share first, so that few rows are sorted; then exactly the sample, the same on every run
    share = min(1.0, 1.1 * (sample + 1000) / max(1, sum(counts.values())))
    (h,) = fresh(docs, "_h")
    drawn = docs.withColumn(h, F.xxhash64("doc_id", "text")).where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.orderBy(h, "doc_id").limit(sample).select("text")
    rows = [(r["f"]["at"], r["f"]["x"], good[r["f"]["code"]]) for r in drawn.select(features("text").alias("f")).collect() if r["f"]["code"] in good]
    return train(sorted(rows))


def scorer(model: tuple[np.ndarray, float]):
    """Column function: the score of a text, 0 for one without words."""
    w, bias = model

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            s, words = statistics(t or "")
            if not words:
                out.append(0.0)
                continue
            at, x = hashed(s, words)
            out.append(1 / (1 + np.exp(-np.clip(np.dot(w[at], x) + bias, -50, 50))))
        return pd.Series(out, dtype=float)

    return score


def scored(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, kept for every document."""
    score = scorer(fit(docs.select("doc_id", "text")))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)


def accepted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, columns as they were."""
    score = scorer(fit(docs.select("doc_id", "text")))
    (name,) = fresh(docs, "_score")
    return docs.withColumn(name, score("text")).where(F.col(name) >= threshold).select(*own_columns(docs))

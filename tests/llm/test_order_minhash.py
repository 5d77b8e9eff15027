"""Fingerprints against a plain-Python rendering of the method."""

import hashlib
import random
import re
import struct

import xxhash

from tarnspark.llm import order_minhash as O

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fold(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h


def cut(text):
    out = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        out += [run] if len(run) <= O.TOKEN else list(run)
    return out


def signature(text):
    """Every hash function by itself: the two least of all elements, sorted by it."""
    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in cut(text)]
    if not tokens:
        return []
    kmers = [fold(tokens[i : i + O.K]) for i in range(len(tokens) - O.K + 1)] if len(tokens) >= O.K else [fold(tokens)]
    seen, elements = {}, []
    for pos, k in enumerate(kmers):
        h = k >> O.POS_BITS
        n = seen[h] = seen.get(h, -1) + 1
        elements.append((xxhash.xxh64_intdigest(struct.pack("<i", n), fold([h])) >> O.POS_BITS if n else h, pos))
    out = []
    for f in range(O.FAMILIES):
        of = [(xxhash.xxh64_intdigest(struct.pack("<i", f), fold([h])) >> O.POS_BITS if f else h, pos) for h, pos in elements]
        for p in O.POINTS:
            least = sorted(of, key=lambda x: ((x[0] - (p >> O.POS_BITS)) % 2**38, x[1]))[:2]
            out.append(fold([h for h, _ in sorted(least, key=lambda x: x[1])]) >> 33)
    return out


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b)) / (O.FAMILIES * O.TURNS) if a or b else 1.0


def test_against_brute_force(docs, odd):
    texts = odd + ["the cat sat on the mat and the cat sat on the mat again " * 5, "a b c", "b a c", "a b c d"]
    got = {r["doc_id"]: r for r in O.fingerprint_documents(docs(texts, extra=True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = signature(t), signature(edited), signature(after)
        r = got[i]
        text = lambda s: "".join(f"{v:08x}" for v in s)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b)), i
        assert abs(r["near_edited"] - likeness(a, b)) < 1e-12 and abs(r["near_next"] - likeness(a, c)) < 1e-12


def test_order_matters_and_repeats(docs):
    rows = [(5, "one two three four five six", "s"), (5, "one two three four five six", "s"), (None, "zz", "s"), (2, "six five four three two one", "s")]
    got = O.fingerprint_documents(docs(rows)).collect()
    assert sorted((r["doc_id"] or 99, r["n_chars"]) for r in got) == [(2, 27), (5, 27), (5, 27), (99, 2)]
    assert len({r["fingerprint"] for r in got}) == 3
    one = O.fingerprint_documents(docs(["only one"])).collect()
    assert one[0]["near_next"] == 1.0
    assert O.fingerprint_documents(docs(rows).limit(0)).count() == 0


def test_swapped_halves(docs):
    """Each selected pair keeps its order with probability one half, however long the text."""
    rng = random.Random(3)
    for n in (40, 60, 100, 2000):
        rows = []
        for _ in range(40):
            w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
            rows += [" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])]
        got = {r["doc_id"]: r["near_next"] for r in O.fingerprint_documents(docs(rows)).collect()}
        mean = sum(got[i] for i in range(0, 80, 2)) / 40
        lost = ((n - 2 - 2) / (n - 2)) ** 2  # the two k-mers at the seam differ
        assert abs(mean - lost / 2) < 0.05, (n, mean)


def test_unspaced_text(docs):
    rng = random.Random(4)
    t = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    got = {r["doc_id"]: r["near_next"] for r in O.fingerprint_documents(docs([t, t[:5] + "x" + t[5:]])).collect()}
    assert got[0] > 0.9

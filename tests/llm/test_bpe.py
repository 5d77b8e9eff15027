"""Encoding against the library on whole texts, with chunks small enough to be stitched, and a round trip."""

import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnspark.llm import bpe

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


def test_documents(docs, odd):
    df = docs(odd, extra=True)
    enc, table, _ = bpe.codec(VOCAB, P.PATTERN)
    got = sorted(map(tuple, bpe.encode_documents(df, VOCAB, P.PATTERN, chunk=1000, overlap=64).collect()))
    assert len(got) == len(odd)
    for doc_id, n, ids_sha, dec_sha, ids in got:
        text = odd[doc_id] or ""
        want = bpe.pack(enc.encode_ordinary(text))
        assert bytes(ids) == want and n == len(want) // 4 and ids_sha == hashlib.sha256(want).hexdigest()
        assert bpe.decode(table, bytes(ids)) == text.encode() and dec_sha == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), VOCAB, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "  ", " ", "\n", "'", "'s", "'re", "ve", "1", "23", "!!", "漢", "\U0001fae8", "\u1c89x", "x" * 40, " " * 30, "'" * 7, "\t", "ABC "]), max_size=120), st.sampled_from([(40, 16), (64, 12), (50, 30)]))
def test_stitching(parts, sizes):
    text, (chunk, overlap) = "".join(parts), sizes
    got = bpe.codec(VOCAB, P.PATTERN)
    cut = [{"at": at, "last": at + chunk + overlap >= len(text), "text": text[at : at + chunk + overlap]} for at in range(0, max(1, len(text) - overlap), chunk)]
    cut = [c | bpe.encode_chunk(c["text"], c["at"], c["last"], chunk, overlap, got) for c in cut]
    assert bpe.stitch(cut, chunk, overlap, got) == bpe.pack(got[0].encode_ordinary(text))


def test_one_unbroken_run():
    """Chunks without any boundary are joined once, not over and over."""
    got, text = bpe.codec("byte_bpe_multi_50k.tiktoken", P.PATTERN), "a b " + "x" * 60_000 + " c d e f"
    calls, real = [], bpe.encode_chunk
    cut = [{"at": at, "last": at + 1064 >= len(text), "text": text[at : at + 1064]} for at in range(0, len(text) - 64, 1000)]
    cut = [c | real(c["text"], c["at"], c["last"], 1000, 64, got) for c in cut]
    bpe.encode_chunk = lambda *a: calls.append(1) or real(*a)
    try:
        assert bpe.stitch(cut, 1000, 64, got) == bpe.pack(got[0].encode_ordinary(text))
    finally:
        bpe.encode_chunk = real
    assert len(calls) <= 2

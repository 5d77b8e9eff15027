"""Op 9: byte-level BPE by overlapping chunk encoding.

Texts are cut into chunks of ``chunk`` code points that overlap by ``overlap``; a short text is one chunk.
Chunks of longer texts are spread over the cluster. Each is split into pre-tokens on its own; matching
needs no state but the start, so once two neighbouring chunks share one pre-token boundary they agree from
there on. The first shared boundary in the overlap is where they are stitched. What lies between boundaries
is encoded by the library, which splits it itself; boundaries are only trusted between pre-tokens of
characters that every Unicode version since 3.2 classifies, so that the two splitters cannot differ there.
Decoding joins the raw bytes of the ids.

Defined cases: null text counts as empty; an empty text has no ids; repeated rows give repeated result
rows; extra input columns are ignored; an empty table gives no rows. A pre-token that spans a whole
overlap leaves no shared boundary: the chunks up to the next agreement are then taken as one.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import text_or_empty

CHUNK = 16_384
OVERLAP = 256
#: A contraction looks at three characters, so pre-tokens this near a chunk's end are not trusted.
MARGIN = 4

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
PART = (
    "uid long, doc_id long, no int, at long, last boolean, text string, "
    "head array<int>, head_n array<int>, head_ids binary, mid_ids binary, tail array<int>, tail_n array<int>, tail_ids binary"
)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes], regex.Pattern]:
    """Encoder, bytes by id and pattern; read once for each worker. A bare file name is looked up on the worker itself."""
    with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return enc, table, regex.compile(pattern)


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def decode(table: list[bytes], packed: bytes) -> bytes:
    return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


def row(doc_id, packed: bytes, table: list[bytes], keep_ids: bool) -> tuple:
    return doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decode(table, packed)).hexdigest(), packed if keep_ids else None


def settled(piece: str) -> bool:
    """Whether every Unicode version since 3.2 classifies all of its characters."""
    return piece.isascii() or all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in piece)


def boundaries(pat: regex.Pattern, text: str, limit: int, whole: bool) -> Iterator[int]:
    """Ends of pre-tokens up to ``limit`` whose two sides are settled; ``whole``: the text's end counts as such."""
    before: tuple[int, bool] | None = None
    for m in pat.finditer(text):
        now = settled(m[0])
        if before and before[1] and now:
            yield before[0]
        if m.end() > limit:
            return
        before = m.end(), now
    if before and whole:
        yield before[0]


def encode_chunk(text: str, at: int, last: bool, stride: int, overlap: int, codec_) -> dict:
    """One chunk: what lies between boundaries of its head and of its tail one by one (absolute ends), the middle as a whole."""
    enc, _, pat = codec_
    head, tail = [], []
    if at or not last:
        for end in boundaries(pat, text, len(text) if last else len(text) - MARGIN, last):
            if last and end > overlap:
                break
            if at and end <= overlap:
                head.append(end)
            elif end >= stride and not last:  # the first boundary of the tail closes the middle
                tail.append(end)
    run = lambda a, b: enc.encode_ordinary(text[a:b])
    head_ids = [run(a, b) for a, b in zip([0, *head], head)]
    tail_ids = [[], *(run(a, b) for a, b in zip(tail, tail[1:]))][: len(tail)]
    mid_from = head[-1] if head else 0
    mid = run(mid_from, len(text) if last else tail[0] if tail else mid_from)
    flat = lambda parts: pack([i for p in parts for i in p])
    return {
        "head": [at + e for e in head], "head_n": [len(p) for p in head_ids], "head_ids": flat(head_ids), "mid_ids": pack(mid),
        "tail": [at + e for e in tail], "tail_n": [len(p) for p in tail_ids], "tail_ids": flat(tail_ids),
    }


def after(ends, counts, packed: bytes, cut: int) -> bytes:
    """Ids of the pieces that begin at ``cut`` or later."""
    return packed[4 * sum(n for e, n in zip(ends, counts) if e <= cut) :]


def upto(ends, counts, packed: bytes, cut: int) -> bytes:
    return packed[: 4 * sum(n for e, n in zip(ends, counts) if e <= cut)]


def shared(cur: dict, nxt: dict) -> list[int]:
    return sorted({*map(int, cur["tail"])} & {*map(int, nxt["head"])})


def stitch(parts: list[dict], stride: int, overlap: int, codec_) -> bytes:
    """Ids of a whole text from its chunks in order."""
    out, cut, i = [], parts[0]["at"], 0
    cur = parts[0]
    while i + 1 < len(parts):
        if both := shared(cur, parts[i + 1]):
            out += [after(cur["head"], cur["head_n"], cur["head_ids"], cut), cur["mid_ids"], upto(cur["tail"], cur["tail_n"], cur["tail_ids"], both[0])]
            cur, cut, i = parts[i + 1], both[0], i + 1
            continue
        # one unbroken pre-token, as a rule: take all chunks up to the next agreement at once
        end, texts = i + 1, [cur["text"][: parts[i + 1]["at"] - cur["at"]]]
        while end + 1 < len(parts) and not shared(parts[end], parts[end + 1]):
            texts.append(parts[end]["text"][: parts[end + 1]["at"] - parts[end]["at"]])
            end += 1
        text = "".join([*texts, parts[end]["text"]])
        merged = {"at": cur["at"], "last": parts[end]["last"], "text": text}
        cur, i = merged | encode_chunk(text, cur["at"], parts[end]["last"], len(text) - overlap, max([overlap, cut - cur["at"]]), codec_), end
    out += [after(cur["head"], cur["head_n"], cur["head_ids"], cut), cur["mid_ids"], cur["tail_ids"]]
    return b"".join(out)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids (little-endian 32-bit)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = codec(vocabulary, pattern)
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                part = pdf.iloc[i : i + 512]
                one = lambda t: stitch([{"at": 0} | encode_chunk(t, 0, True, chunk, overlap, got)], chunk, overlap, got)
                rows = [row(d, one(t), got[1], keep_ids) for d, t in zip(part["doc_id"], part["text"])]
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = codec(vocabulary, pattern)
        for pdf in batches:
            for r in pdf.to_dict("records"):
                yield pd.DataFrame([r | encode_chunk(r["text"], r["at"], r["last"], chunk, overlap, got)])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        got = codec(vocabulary, pattern)
        parts = pdf.sort_values("no").to_dict("records")
        rows = [row(parts[0]["doc_id"], stitch(parts, chunk, overlap, got), got[1], keep_ids)]
        return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    n = F.length("text")
    single = docs.where(n <= chunk).mapInPandas(whole, OUT)
    cut = (
        docs.where(n > chunk)
        .select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", n.alias("n"))
        .select("uid", "doc_id", "text", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - overlap - 1, F.lit(chunk))).alias("no", "at"))
        .select("uid", "doc_id", "no", F.col("at").cast("long").alias("at"), (F.col("at") + chunk + overlap >= F.col("n")).alias("last"), F.substring("text", F.col("at") + 1, F.lit(chunk + overlap)).alias("text"))
    )
    long = cut.repartition("uid", "no").mapInPandas(pieces, PART).groupBy("uid").applyInPandas(join, OUT)
    out = single.unionByName(long)
    return out if keep_ids else out.drop("ids")

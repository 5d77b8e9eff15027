"""The pipeline's stages in order, each on what the one before kept."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers

from tarnspark.llm import bpe, cube, quality, registry
from tarnspark.llm.common import Scratch
from tests.llm.test_near_dedup import brute
from tests.llm.test_quality import texts


def test_stages(spark, docs, tmp_path):
    good = [t for y, t in texts(3, 90) if y]
    junk = [t for y, t in texts(3, 90) if not y]
    near = good[0].split()
    near[5] = "changed"
    df = docs([None, ""] + good + [" ".join(near)] + junk)
    first = 2
    scratch, seen, cur = Scratch(spark), [], df
    for name, stage in corpus_pipeline.STAGES:
        cur = scratch.keep(stage(spark, cur, str(tmp_path)))
        seen.append((name, cur))
    by = dict(seen)
    assert all(seen[i][1].columns == df.columns for i in range(4))
    ids = lambda n: {r["doc_id"] for r in by[n].collect()}
    last_good = first + len(good)
    assert ids("quality classifier") == set(range(first, last_good + 1))
    assert ids("line dedup") == ids("quality classifier")
    assert ids("near dedup") == set(range(first, last_good))
    assert ids("mixing") <= ids("near dedup")
    out = by["tokenisation"].collect()
    assert len(out) == by["mixing"].count() and all(r["n_tokens"] > 0 for r in out)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in run) == sorted((r["doc_id"], r["ids_sha256"]) for r in out)


def test_stages_against_plain_computations(spark, docs, tmp_path):
    """Line dedup against its SQL, near dedup against all pairs, mixing against its totals, tokens against the library; judged stage by stage."""
    rng = random.Random(11)
    good = [t for y, t in texts(5, 60) if y]
    block = " ".join("".join(rng.choice("abcdeilnorst") for _ in range(5)) for _ in range(55)) + "."
    near = []
    for t in good[:6]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    rows = good + near + [f"{t}\n{block}" for t in good[20:26]] + [None, "one two three"]
    df = docs(rows, extra=True).dropDuplicates(["doc_id"])
    stage = dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark)
    run = lambda name, d: scratch.keep(stage[name](spark, d, str(tmp_path)))

    kept = run("quality classifier", df)
    scores = {r["doc_id"]: r["kept"] for r in quality.scored(df).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, ok in scores.items() if ok} >= set(range(len(good)))

    con = duckdb.connect()
    con.register("documents", kept.select("doc_id", "text").toPandas())
    want = {d: t for d, _, n, t in con.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({registry.ORACLES['op6_template_tree']})").fetchall() if not n or t.strip()}
    lines = run("line dedup", kept)
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert got == want and sum(block in t for t in got.values()) == 1

    ids = sorted(got)
    labels, _ = brute([got[i] for i in ids], 5, 80)
    alone = run("near dedup", lines)
    assert {r["doc_id"] for r in alone.collect()} == {i for at, i in enumerate(ids) if labels[at] == at} and len({*labels}) < len(ids)

    mixed = run("mixing", alone)
    copies = {r["doc_id"]: r["copies"] for r in cube.mix(alone).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})

    enc = bpe.codec("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)[0]
    for r in run("tokenisation", mixed).collect():
        assert bytes(r["ids"]) == bpe.pack(enc.encode_ordinary({x: t for x, t in got.items()}[r["doc_id"]]))


def test_odd_tables_through_all_stages(spark, docs, odd, tmp_path):
    """Null ids, repeated rows, shared ids, very long texts and clashing columns pass; an empty table gives no rows."""
    good = [t for y, t in texts(7, 40) if y]
    rows = [(None, good[0], "s"), (None, good[1], None), (5, good[2], "s"), (5, good[2], "s"), (5, good[3], "t"), (6, " ".join(good) * 40, "s")] + [(10 + i, t, "u") for i, t in enumerate(odd + good[4:20])]
    df = docs(rows, extra=True)
    for table, some in ((df, True), (df.limit(0), False)):
        cur = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            cur = Scratch(spark).keep(stage(spark, cur, str(tmp_path)))
            assert cur.columns == df.columns, name
            if some and name == "near dedup":  # one row of the repeated one, and the other text of that id
                assert Counter(r["doc_id"] for r in cur.collect())[5] == 2
        out = corpus_pipeline.STAGES[-1][1](spark, cur, str(tmp_path)).collect()
        assert (len(out) > 0) == some and all(r["n_tokens"] > 0 for r in out)
        if some:
            left = cur.collect()
            assert any(r["doc_id"] is None for r in left) and any(len(r["text"]) > 100_000 for r in left)
            assert {r["text"] for r in left if r["doc_id"] == 5} <= {good[2], good[3]}

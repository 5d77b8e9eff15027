"""Op 7: mixing sources to target weights by the cube method.

Source targets come from water-filling over the table of sources. Every document of a source
then has the same expected number of copies; the whole part is taken outright and the fractional part
is an inclusion probability. Flight phase: probabilities move inside the null space of two balancing
constraints, documents and words, so both totals of a source stay put while documents settle at 0 or
1. It runs in blocks of a source (so a source with a third of all rows is many tasks); each block
passes its two unsettled documents and a few small settled ones up to the next level, until one block
a source is left. Landing: there the last documents are settled, and single copies are exchanged
among the documents that came up until the word total is as near its target as they allow.

Defined cases: null or wordless texts have size 0 and are taken 0 words; null is a source of its own,
ordered last; repeated rows are units of their own; ties are settled by a hash of the unit, so reruns
agree; a table without words takes nothing; extra input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import WORD, Scratch, fresh, own_columns, placed, split_join, text_or_empty

#: The weights that sources take in turn, and the most often that a document is taken.
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 1024
FAN_IN = 128
#: Settled documents that a block passes up for the landing.
SPARE = 6


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: shares by weight, none above ``most`` times its source's words.

    As the rule goes: sources whose share of what is left exceeds their cap take the cap, and the rest is
    shared anew, until none exceeds. Each turn is a few sums; sources may be many (hosts, say), so no task
    holds them all, and their numbering goes by ranges.
    """
    scratch = Scratch(sizes.sparkSession)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = placed(by, [F.col("source").asc_nulls_last()], scratch)
    at = F.pmod(F.col("_place") - 1, F.lit(len(weights)))
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * most)
    by = scratch.keep(by.drop("_place"))
    total, every = by.agg(F.sum("source_size"), F.sum("w")).first()
    level, filled = float(total or 0) / (every or 1.0), -1
    while True:
        # no float sum decides a tie: a source at its cap stays there, as the level only rises
        full = F.col("cap") <= F.col("w") * level
        n, caps, free = by.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if n == filled or not free:
            break
        filled, level = n, (float(total) - float(caps) * most) / free
    return by.select("source", "source_size", "n_docs", F.least(F.col("w") * F.lit(level), F.col("cap")).alias("target"))


def flight(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Move probabilities along null vectors of (1, size) until at most two are inside (0, 1)."""
    p = p.copy()
    eps = 1e-9
    todo = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    live: list[int] = []
    k = 0
    while True:
        while len(live) < 3 and k < len(todo):
            live.append(todo[k])
            k += 1
        if len(live) < 3:
            break
        a, b, c = live
        v = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if v == (0, 0, 0):
            v = (1.0, -1.0, 0.0)
        step = math.inf
        for i, u in zip(live, v):
            if u > 0:
                step = min(step, (1 - p[i]) / u)
            elif u < 0:
                step = min(step, p[i] / -u)
        for i, u in zip(live, v):
            p[i] = min(1.0, max(0.0, p[i] + step * u))
        live = [i for i in live if eps < p[i] < 1 - eps]
    p[p <= eps] = 0.0
    p[p >= 1 - eps] = 1.0
    return p


def land(p: np.ndarray, x: np.ndarray, whole: int, most: int) -> np.ndarray:
    """Settle what the flight left, then exchange single copies while the word total comes nearer its target."""
    goal = float(np.dot(p, x))
    out = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    # dropping the document constraint: of the pair, one is settled by the other's words
    for i in sorted(open_, key=lambda i: (-x[i], i)):
        out[i] = 1.0 if abs(np.dot(out, x) + (1 - out[i]) * x[i] - goal) <= abs(np.dot(out, x) - out[i] * x[i] - goal) else 0.0
    for _ in range(64):
        gap = goal - float(np.dot(out, x))
        can = np.where(out + whole + (1 if gap > 0 else -1) <= most, 1, 0) * (out + whole + (1 if gap > 0 else -1) >= 0)
        left = np.where(can > 0, np.abs(abs(gap) - x), np.inf)
        i = int(np.argmin(left)) if len(left) else -1
        if i < 0 or not left[i] < abs(gap):
            break
        out[i] += 1 if gap > 0 else -1
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row a document, the copies that the mix takes of it."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text_or_empty()).alias("size"))
    same = scratch.keep(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    units = same.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("occ"))
    targets = scratch.keep(source_targets(units, weights, most))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # one row a source: no more than its distinct names; the join is left to Spark's own size check
    units = units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    units = units.withColumn("whole", F.least(F.floor(ratio), F.lit(most)).cast("int")).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - F.col("whole"))).otherwise(0.0))
    code = F.xxhash64("doc_id", "occ", "size")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long")
    level = units.withColumn("code", code).withColumn("block", F.pmod("code", blocks)).withColumn("deep", blocks)

    schema = "doc_id long, source string, size long, occ long, source_size long, target double, whole int, block long, deep long, code long, p double, x double, up boolean"

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "code", "doc_id", "occ"], ascending=[False, True, True, True]).reset_index(drop=True)
        size, whole = pdf["size"].to_numpy(float), int(pdf["whole"].iloc[0])
        p = flight(pdf["p"].to_numpy(float), size)
        last = int(pdf["deep"].iloc[0]) == 1
        if last:
            p = land(p, size, whole, most)
            up = np.zeros(len(p), bool)
        else:
            up = (p > 0) & (p < 1)
            spare = [i for i in np.flatnonzero(~up) if size[i] > 0]
            up[spare[-SPARE // 2 :] + spare[len(spare) // 2 : len(spare) // 2 + SPARE // 2]] = True
        return pdf.assign(x=p, up=up)[[c.split()[0] for c in schema.split(", ")]]

    deep, done = max(1, math.ceil(largest / block)), []
    while True:
        out = scratch.keep(level.select("doc_id", "source", "size", "occ", "source_size", "target", "whole", "block", "deep", "code", "p").groupBy("source", "block", "deep").applyInPandas(settle, schema))
        done.append(out.where(~F.col("up")))
        if deep == 1:
            break
        deep = math.ceil(deep / fan_in)
        up = F.greatest(F.lit(1), F.ceil(F.col("deep") / fan_in)).cast("long")
        level = out.where("up").withColumn("p", F.col("x")).withColumn("deep", up).withColumn("block", F.pmod("block", F.col("deep")))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("x")).otherwise(0).cast("long")
    return all_.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, columns as they were.

    Rows that share doc_id, source and size share their copies as evenly as whole copies can, in order of
    a hash of their text: each gets the whole part, the first ones one more. No copy is lost or made up.
    """
    scratch = Scratch(docs.sparkSession)
    id_, copies, rows, place, key, times = fresh(docs, "_id", "_copies", "_rows", "_place", "_key", "_times")
    own = own_columns(docs)
    mixed = scratch.keep(mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
    by_id = mixed.groupBy(F.col("doc_id").alias(id_)).agg(F.sum("copies").alias(copies), F.sum("rows").alias(rows))
    alone = by_id.where(F.col(rows) == 1).where(F.col(copies) > 0).select(id_, copies)
    same = lambda c: F.col("doc_id").cast("long").eqNullSafe(F.col(c))
    repeat = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    out = docs.join(alone, same(id_)).withColumn(times, repeat(F.col(copies))).select(*own)
    several = scratch.keep(by_id.where(F.col(rows) > 1).select(id_))
    if not several.limit(1).count():
        return out
    of = lambda doc_id, source, size: F.xxhash64(doc_id, source, size)
    found = docs.join(several, same(id_), "left_semi").withColumn(key, of(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(text_or_empty())))
    named = placed(found.withColumn(rows, F.struct(F.xxhash64(text_or_empty()), F.monotonically_increasing_id())), [key, rows], scratch, place)
    group = mixed.select(of(F.col("doc_id"), F.col("source"), F.col("size")).alias(key), F.col("copies").alias(copies), F.col("rows").alias(times))
    named = scratch.keep(named.drop(rows))
    group = group.join(named.groupBy(key).agg(F.min(place).alias(id_)), key).where(F.col(copies) > 0)
    each = split_join(named, scratch.keep(group), key, times)
    more = (F.col(place) - F.col(id_)) < F.col(copies) % F.col(times)
    take = F.floor(F.col(copies) / F.col(times)) + more.cast("int")
    return out.unionByName(each.withColumn(copies, take).where(F.col(copies) > 0).withColumn(times, repeat(F.col(copies))).select(*own))

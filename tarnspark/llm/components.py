"""Connected components of a link table by alternating large and small stars, each step written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import Scratch, split_join


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """node, label (the least node reachable) for every node that has a link. Rounds grow with the log of a chain's length.

    A hub holds as many links as its component has nodes: its least neighbour is sent to its links, not they to it.
    """
    edges = scratch.keep(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("c")).where("c > 0"))
        large = scratch.keep(split_join(both.where("v > u"), least, "u", "c").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(least)
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")))
        small = split_join(large, least, "u", "c")
        hook = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(hook.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        for kept in (least, large, edges):
            scratch.drop(kept)
        was, edges, state = state, new, _state(new)
        if state == was:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

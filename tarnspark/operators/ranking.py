"""Ranking shapes shared by the reference queries: top-N with ties, leaders, zero-filled counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_with_ties(df: DataFrame, by: str | Column, n: int, rank: str = "position") -> DataFrame:
    """Rows whose competition rank by ``by`` descending is at most n; ties at the cutoff stay.

    The filter on the rank becomes a partial limit before the shuffle (WindowGroupLimit), so only about n
    rows a partition meet in the one task that ranks them.
    """
    key = F.col(by) if isinstance(by, str) else by
    return df.withColumn(rank, F.rank().over(Window.orderBy(key.desc()))).where(F.col(rank) <= n)


def leaders(df: DataFrame, by: str | Column) -> DataFrame:
    """All rows tied for the first place."""
    return top_with_ties(df, by, 1, "_first").drop("_first")


def zero_filled(dim: DataFrame, counts: DataFrame, on: str, count: str) -> DataFrame:
    """Every row of ``dim`` with its count, 0 where there is none."""
    return dim.join(counts, on, "left").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def pair_counts(left: DataFrame, right: DataFrame, link: str, left_key: str, right_key: str, count: str) -> DataFrame:
    """How many ``link`` values each (left, right) pair has in common: an equi-join, then a grouped count."""
    return left.join(right, link).groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias(count))


def pruned_pair_counts(left: DataFrame, right: DataFrame, link: str, left_key: str, right_key: str, count: str, sample: int = 200) -> DataFrame:
    """The same for the leading pairs only, pruned exactly.

    A pair never has more in common than either side has alone. The best pair among the busiest ``sample``
    right keys is a floor for the best of all, so keys with fewer links than that cannot lead.
    """
    busy = lambda d, k: d.groupBy(k).agg(F.count(F.lit(1)).alias("_n"))
    r = busy(right, right_key)
    some = r.orderBy(F.desc("_n"), right_key).limit(sample).select(right_key)
    floor = pair_counts(left, right.join(some, right_key, "left_semi"), link, left_key, right_key, count).agg(F.coalesce(F.max(count), F.lit(1)).alias("_floor"))
    strong = lambda d, k: d.join(busy(d, k).join(floor, F.col("_n") >= F.col("_floor")).select(k), k, "left_semi")
    return pair_counts(strong(left, left_key), strong(right, right_key), link, left_key, right_key, count)


def rounded_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator / denominator in double precision, rounded so that equal ratios tie; null on zero."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def order(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Deterministic output order: every reference query ends on a key."""
    cols: Sequence = keys
    return df.orderBy(*cols)

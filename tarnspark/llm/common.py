"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word contracts, as a regex class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tarnspark-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        at = "file://" + _own_dir[0]
    return at.rstrip("/")


class Scratch:
    """Written intermediate tables in the shared folder, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tarnspark/{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """``df``, written and read again; ``batch``: rows that Python workers get at once, for wide rows."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        was = self.spark.conf.get(name)
        try:
            if batch:
                self.spark.conf.set(name, batch)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(name, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later plan reads."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n += "_"
        out.append(n)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside one native expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Most keys that ``split_join`` sends to every task.
HOT_KEYS = 4096


def split_join(facts: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join on ``key`` of which ``keyed`` has one row each, with ``count``, at least 1, of the facts that may match.

    Keys that hold more than 1 / HOT_KEYS of all counts are fewer than HOT_KEYS whatever the input; they
    are broadcast, so their facts stay where they are. The rest goes through a shuffle in which no key
    holds more than that share.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    bound = max(1000, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(count) > bound))
    cold = keyed.where(F.col(count) <= bound)
    if not keyed.where(F.col(count) > bound).limit(1).count():
        return facts.join(cold, key)
    rest = facts.join(F.broadcast(keyed.where(F.col(count) > bound).select(key)), key, "left_anti")
    return facts.join(hot, key).unionByName(rest.join(cold, key))


def salted_join(facts: DataFrame, keyed: DataFrame, key: str, by: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, of which ``keyed`` has one (perhaps wide) row each.

    Keys of more than 1 / HOT_KEYS of the facts are fewer than HOT_KEYS; only their names and counts are
    broadcast. Their facts are dealt by a hash of ``by`` to copies of the keyed row, so that none is met
    by more than that share. ``counts`` (key, _c) may be given where it is cheaper to have from elsewhere.
    """
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_c")) if counts is None else counts
    total = counts.agg(F.sum("_c")).first()[0] or 0
    bound = max(1000, total // HOT_KEYS)
    hot = counts.where(F.col("_c") > bound).select(key, F.ceil(F.col("_c") / bound).cast("long").alias("_salts"))
    if not hot.limit(1).count():
        return facts.join(keyed, key)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = facts.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts)).drop("_salts")
    copies = keyed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def placed(df: DataFrame, order: list, scratch: Scratch, name: str = "_place", of: str | None = None) -> DataFrame:
    """The rows with their place, from 1, in the order given; with ``of``, the sum of that column over the rows before.

    Rows are range-partitioned and kept, each range is numbered by itself, and the totals of the ranges before
    come from a table of one row a range. No task sorts more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.keep(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))
    total = F.sum(of) if of else F.count(F.lit(1))
    sizes = ranged.groupBy("_pid").agg(total.alias("_c"))
    before = F.broadcast(sizes.select("_pid", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_before")))
    inside = Window.partitionBy("_pid").orderBy(*order)
    own = F.coalesce(F.sum(of).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if of else F.row_number().over(inside)
    return ranged.withColumn(name, own).join(before, "_pid").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_pid", "_before")


def prefix_sums(arr: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array<int>; two levels, so long arrays stay near linear."""
    zero = F.array(F.lit(0).cast("int"))

    def grow(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array((F.element_at(a, -1) + x).cast("int"))))

    def body(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(block))
        parts = F.transform(starts, lambda s: F.slice(xs, s + 1, F.lit(block)))
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("int"), lambda a, x: a + x))
        return let(
            F.struct(parts.alias("p"), grow(sums).alias("b")),
            lambda pb: F.flatten(
                F.transform(
                    pb["p"],
                    lambda p, i: let(
                        F.struct(F.get(pb["b"], i).alias("base"), F.slice(grow(p), 1, F.size(p)).alias("in")),
                        lambda q: F.transform(q["in"], lambda v: (v + q["base"]).cast("int")),
                    ),
                )
            ),
        )

    return F.when(F.size(arr) == 0, F.array().cast("array<int>")).otherwise(let(arr, body))

"""Op 5 [native]: Order MinHash fingerprints, sensitive to edit distance.

A text is cut into tokens (runs without white space; those of more than ``TOKEN`` code points, as in
unspaced scripts, in single code points, so that an insertion changes only the k-mers around it).
Every run of K tokens is a k-mer; the j-th occurrence of a k-mer counts as an element of its own. Each of
``FAMILIES * TURNS`` hash functions selects the two least of all elements, puts them back into text order
and hashes them as a tuple. Likeness is the share of hash functions whose tuples agree.

A family is a hash of the elements; its functions are rotations of it, h(x) - p modulo the range, so the
two least of all elements are the two that follow p on the ring (past the end, the first ones). One sort
serves all rotations of a family, and no function sees but a part of the elements.

All of it is array expressions on the row: no Python, nothing gathered per group. Elements are numbered
once, in a sorted array of longs that hold hash (38 bits) and position (26 bits); families rehash that
array in place and sort it. A text may have 2 ** 26 - 1 tokens; beyond that positions repeat, and only
the text order of some tuples suffers.

Defined cases: null text is empty; an empty text selects nothing, and two empty texts have likeness 1; a
text of fewer than K tokens is a single k-mer, and a tuple of one element is that element; rows equal in
doc_id and text are one document for the order of documents and come out once a row; rows that share a
doc_id are ordered by a hash of their text; a null doc_id comes last; a table of one document is its own
next one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnspark.llm.common import SPACE, Scratch, let, text_or_empty

K = 3
FAMILIES, TURNS = 4, 16
TOKEN = 16
#: A run without white space, or a code point of a longer one.
PIECES = rf"(?<![^{SPACE}])[^{SPACE}]{{1,{TOKEN}}}+(?![^{SPACE}])|[^{SPACE}]"
POS_BITS = 26
_POS = (1 << POS_BITS) - 1
#: Fixed points of the ring; no element has position 0, so none equals a point.
POINTS = [(i - TURNS // 2) * (2**64 // TURNS) for i in range(TURNS)]


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_POS))


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, POS_BITS)


def _packed(h: Column, pos: Column) -> Column:
    return h.bitwiseAND(F.lit(~_POS)).bitwiseOR(pos.cast("long"))


def kmers(text: Column) -> Column:
    """Sorted (hash, position) longs of the k-mers."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda t: F.xxhash64(t))

    def of(h: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)])
        many = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: _packed(at(i), i + 1))
        one = F.array(_packed(F.xxhash64(h), F.lit(1)))
        return F.when(F.size(h) >= K, F.sort_array(many)).when(F.size(h) > 0, one).otherwise(F.array().cast("array<long>"))

    return let(hashes, of)


def occurrences(s: Column) -> Column:
    """How many earlier occurrences each sorted k-mer has: run lengths by doubling, as long as runs go on."""
    first = F.transform(s, lambda x, i: F.when((i > 0) & (_hash(x) == _hash(F.get(s, i - 1))), 1).otherwise(0))

    def step(acc: Column, j: Column) -> Column:
        cap = F.pow(F.lit(2), j).cast("int")
        grown = lambda d: F.transform(d, lambda v, i: F.when(v == cap, v + F.get(d, i - v)).otherwise(v))
        on = acc["on"] & (F.array_max(acc["d"]) >= cap)
        return F.when(acc["on"], F.struct(F.when(on, grown(acc["d"])).otherwise(acc["d"]).alias("d"), F.coalesce(on, F.lit(False)).alias("on"))).otherwise(acc)

    start = F.struct(first.alias("d"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(POS_BITS)), start, step, lambda acc: acc["d"])


def elements(s: Column) -> Column:
    """Sorted (hash, position) longs of the occurrence-numbered k-mers; a first occurrence keeps its k-mer's hash."""

    def of(d: Column) -> Column:
        named = F.transform(s, lambda x, i: F.when(F.get(d, i) == 0, x).otherwise(_packed(F.xxhash64(_hash(x), F.get(d, i)), _pos(x))))
        return F.when(F.array_max(d) > 0, F.sort_array(named)).otherwise(s)

    return let(occurrences(s), of)


def family(e: Column, f: int) -> Column:
    """The elements under the f-th hash, sorted."""
    return e if f == 0 else F.sort_array(F.transform(e, lambda x: _packed(F.xxhash64(_hash(x), F.lit(f)), _pos(x))))


def signature(text: Column) -> Column:
    """array<int> of FAMILIES * TURNS tuples; empty for an empty text."""
    points = F.array(*[F.lit(p).cast("long") for p in POINTS])

    def tuple_(e: Column, first: Column) -> Column:
        at = lambda i: F.get(e, F.pmod(i, F.size(e)))
        pair = lambda x, y: F.when(_pos(x) < _pos(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
        two = F.when(F.size(e) > 1, pair(at(first), at(first + 1))).otherwise(F.xxhash64(_hash(at(first))))
        return F.shiftrightunsigned(two, 33).cast("int")

    def tuples(e: Column) -> Column:
        # a point's rank among elements and points, less the points before it, is how many elements are below it
        ranks = let(F.sort_array(F.concat(e, points)), lambda m: F.array(*[(F.array_position(m, F.lit(p).cast("long")) - 1 - j).cast("int") for j, p in enumerate(POINTS)]))
        return F.transform(ranks, lambda r: tuple_(e, r))

    def of(e: Column) -> Column:
        every = F.concat(*[let(family(e, f), tuples) for f in range(FAMILIES)])
        return F.when(F.size(e) > 0, every).otherwise(F.array().cast("array<int>"))

    return let(kmers(text), lambda s: let(elements(s), of))


def fingerprint(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same.cast("double") / F.lit(FAMILIES * TURNS))


def next_documents(keys: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """doc_id, th and those of the next document in (doc_id, th) order, the last one's being the first's.

    Keys are range-partitioned, each range is ordered by itself, and a range's last key takes the head of
    the next range from a table of one row a range.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("th").asc()]
    ranged = scratch.keep(keys.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()))
    key = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    heads = ranged.groupBy("pid").agg(F.min(key).alias("head"))
    by_pid = Window.orderBy("pid")
    every = Window.partitionBy(F.lit(0))
    heads = heads.select("pid", F.coalesce(F.lead("head").over(by_pid), F.min(F.struct("pid", "head")).over(every)["head"]).alias("after"))
    inside = F.lead(key).over(Window.partitionBy("pid").orderBy(*order))
    out = ranged.withColumn("next", inside).join(heads, "pid").withColumn("next", F.coalesce("next", "after"))
    return out.select("doc_id", "th", "n", F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    keys = scratch.keep(docs.select("doc_id", "th", F.length("text").alias("n")).groupBy("doc_id", "th", "n").agg(F.count(F.lit(1)).alias("rows")))
    repeats = keys.where("rows > 1").limit(1).count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = scratch.keep(next_documents(keys.drop("rows"), scratch, parts))

    quarter = F.floor(F.col("n") / 4).cast("int")
    same = lambda a, b, x, y: a.eqNullSafe(b) & (x == y)
    wanted = order.select(F.col("doc_id").alias("for_id"), F.col("th").alias("for_th"), "n", "next_id", "next_th")
    heads = wanted.join(docs, same(F.col("next_id"), F.col("doc_id"), F.col("next_th"), F.col("th"))).select("for_id", "for_th", "n", F.substring("text", F.lit(1), quarter).alias("head"))
    if repeats:
        heads = heads.dropDuplicates(["for_id", "for_th"])
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - quarter), F.col("head"))
    both = docs.join(heads, same(F.col("doc_id"), F.col("for_id"), F.col("th"), F.col("for_th"))).select("doc_id", "th", "n", "text", edited.alias("edited"))
    signed = scratch.keep(both.select("doc_id", "th", "n", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text")).alias("sig"), signature(F.col("edited")).alias("edited_sig")))

    after = signed.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), F.col("sig").alias("next_sig"))
    if repeats:
        after = after.dropDuplicates(["a_id", "a_th"])
    pairs = order.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), "next_id", "next_th").join(after, same(F.col("next_id"), F.col("a_id"), F.col("next_th"), F.col("a_th"))).select("p_id", "p_th", "next_sig")
    out = signed.join(pairs, same(F.col("doc_id"), F.col("p_id"), F.col("th"), F.col("p_th")))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )

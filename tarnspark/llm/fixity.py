"""Op 2: Merkle fixity audit of replicated WARC archives.

``warc`` writes pages as WARC records, header fields, payload and closing lines, in the order of their
ids, with each record's length and byte offset in its archive. Records stand at ordered offsets (their
key). A record is hashed over all its bytes; the rows at one offset are combined without order, so that
repeated rows need no sort. ``FAN`` consecutive offsets form a range, FAN ranges a range of ranges, up to
the root; each node hashes its children in order. Two replicas are compared at their roots, and only
ranges whose nodes differ are opened, level by level, down to the records, whose bytes are then named.

Records and nodes of both replicas are written once to the shared folder; each level is a grouped sum
of at most FAN children a node, and descending is a semi-join with the mismatches of the level above.

Defined cases: null fields differ from empty ones (a null url has no header line, a null payload the
line WARC-Truncated); records with a null key share one offset of their own, before all others in the
archive; a missing or extra record is reported as such; equal repeated rows count, and a changed count
is ``altered``; bytes of an offset with several records run from the first to the last; an empty replica
differs from any other at the root; extra columns are ignored; two empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import Scratch, placed

FAN_BITS = 8
FAN = 1 << FAN_BITS


#: The line that opens a record, and what ends a line.
VERSION, CRLF = "WARC/1.1", "\r\n"


def warc(pages: DataFrame) -> DataFrame:
    """page_id, record: every page as one WARC record of type resource, with the digest and length of its payload."""
    payload = F.coalesce("html", F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    known = lambda c, text: F.when(c.isNull(), F.lit("")).otherwise(text)
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.lit("resource")), known(F.col("page_id"), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")))),
        known(F.col("url"), line("WARC-Target-URI", F.col("url"))), F.when(F.col("html").isNull(), line("WARC-Truncated", F.lit("unspecified"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))), line("Content-Type", F.lit("text/html")), line("Content-Length", F.octet_length(payload)), F.lit(CRLF),
    )
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(head, payload, F.lit(CRLF * 2)).alias("record"))


def positions(archive: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, byte_offset, byte_length of what stands at each key, records being ordered by key (then by hash) without gaps."""
    sizes = archive.select("page_id", F.octet_length("record").cast("long").alias("bytes")).groupBy("page_id").agg(F.sum("bytes").alias("byte_length"))
    order = [F.col("page_id").asc_nulls_first()]
    return placed(sizes, order, scratch, "byte_offset", "byte_length").select("page_id", "byte_offset", "byte_length")


def record_hash(fields: list[str]) -> Column:
    """SHA-256 over the fields, each with its length in bytes; null is told from empty."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *map(part, fields)), 256)


def leaves(archive: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """nul, at, hash, n: one row an offset. Sums of hash words are free of order and combine before the shuffle."""
    r = archive.select(F.col(key).cast("long").alias("at"), record_hash(fields).alias("h"))
    r = r.select(F.col("at").isNull().alias("nul"), F.coalesce("at", F.lit(0)).alias("at"), "h", *[F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"w{i}") for i in range(4)])
    sums = r.groupBy("nul", "at").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    many = F.sha2(F.concat_ws(",", F.col("n"), *[F.col(f"w{i}") for i in range(4)]), 256)
    return sums.select("nul", "at", F.when(F.col("n") == 1, F.col("h")).otherwise(many).alias("hash"), "n")


def parents(nodes: DataFrame) -> DataFrame:
    """One level up: ranges of FAN offsets, hashed over their children in order."""
    child = F.struct(F.col("at"), F.col("hash"))
    grouped = nodes.groupBy("nul", F.shiftright("at", FAN_BITS).alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["at"].cast("string"), F.lit("="), x["hash"])), ",")
    return grouped.select("nul", F.col("up").alias("at"), F.sha2(text, 256).alias("hash"))


class Tree:
    """Levels of one replica, leaves first; the last has at most three nodes (negative, other and null keys)."""

    def __init__(self, archive: DataFrame, key: str, fields: list[str], scratch: Scratch):
        self.levels = [scratch.keep(leaves(archive, key, fields))]
        self.scratch = scratch

    def grow(self, depth: int) -> None:
        while len(self.levels) < depth:
            self.levels.append(self.scratch.keep(parents(self.levels[-1])))

    def span(self) -> tuple[int, int]:
        lo, hi = self.levels[0].agg(F.min("at"), F.max("at")).first()
        return lo or 0, hi or 0

    def root(self) -> str | None:
        """Hash of the top nodes; null for an empty archive."""
        import hashlib

        top = sorted((r["nul"], r["at"], r["hash"]) for r in self.levels[-1].collect())
        return hashlib.sha256(repr(top).encode()).hexdigest() if top else None


def depth_for(lo: int, hi: int) -> int:
    d = 1
    while not (lo in (0, -1) and hi in (0, -1)):
        lo, hi, d = lo >> FAN_BITS, hi >> FAN_BITS, d + 1
    return d


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that are not alike in both, with each side's hash."""
    x = a.select("nul", "at", F.col("hash").alias("a_hash"))
    y = b.select("nul", "at", F.col("hash").alias("b_hash"))
    return x.join(y, ["nul", "at"], "full").where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))


def audit(primary: DataFrame, replica: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, dict]:
    """(rows, summary): offset, status, hashes and the smallest range that holds each damaged record; roots, depth and nodes opened."""
    scratch = Scratch(primary.sparkSession)
    one, two = Tree(primary, key, fields, scratch), Tree(replica, key, fields, scratch)
    spans = one.span() + two.span()
    depth = depth_for(min(spans), max(spans))
    one.grow(depth)
    two.grow(depth)
    roots = one.root(), two.root()
    opened, above = [], None
    for level in reversed(range(depth)):
        a, b = one.levels[level], two.levels[level]
        if roots[0] == roots[1]:
            a, b = a.limit(0), b.limit(0)
        elif above is not None:
            down = above.select("nul", F.col("at").alias("up"))
            inside = lambda d: d.withColumn("up", F.shiftright("at", FAN_BITS)).join(down, ["nul", "up"], "left_semi").drop("up")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        above = scratch.keep(differing(a, b))
        opened.append(above)
    status = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").otherwise("altered")
    low = F.shiftleft(F.shiftright("at", FAN_BITS), FAN_BITS)
    at = lambda c: F.when(~F.col("nul"), c)
    rows = above.select(at(F.col("at")).alias("page_id"), status.alias("status"), F.col("a_hash").alias("primary_hash"), F.col("b_hash").alias("replica_hash"), at(low).alias("range_start"), at(low + FAN).alias("range_end"))
    return rows, {"roots": roots, "depth": depth, "levels": opened}


def audit_warc(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The audit of two archives of ``warc`` records, with the bytes at which damage lies.

    byte_offset and byte_length are those of the primary archive; of an extra record those of the replica.
    """
    scratch = Scratch(primary.sparkSession)
    one, two = scratch.keep(primary.select("page_id", "record")), scratch.keep(replica.select("page_id", "record"))
    found = scratch.keep(audit(one, two, "page_id", ["record"])[0])
    extra = found["status"] == "extra"
    at = lambda rows, archive: rows.join(positions(archive, scratch).withColumnRenamed("page_id", "_id"), F.col("page_id").eqNullSafe(F.col("_id"))).drop("_id")
    return at(found.where(~extra), one).unionByName(at(found.where(extra), two))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with damage by rule, so that an audit has something to find.

    Of the offsets, those = 13 mod 101 have a character appended, those = 29 mod 211 are gone, and those
    = 7 mod 307 have a second record.
    """
    k = F.col("page_id")
    changed = F.when(F.pmod(k, F.lit(101)) == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html"))
    base = pages.where(k.isNull() | (F.pmod(k, F.lit(211)) != 29)).select("page_id", "url", changed.alias("html"))
    return base.unionByName(pages.where(F.pmod(k, F.lit(307)) == 7).select(-k - 1, "url", "html").toDF("page_id", "url", "html"))

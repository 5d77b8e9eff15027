"""Op 8: MinHash near-dedup with tensored banding.

Documents with equal shingle sets form a class; only classes are compared. Two small collections of
``groups`` minhash groups each (``rows`` minhashes a group) give groups * groups table keys by pairing
a group of one with a group of the other, so 64 tables need 32 minhashes. At a similarity s a pair
shares some table with probability (1 - (1 - s^rows)^groups)^2, 0.99993 at s = 0.85.

A table's bucket is never expanded into pairs: its members are compared with a few pivots, the first
members under fixed orders (one of them by how much company a class has in all tables, so that the
middle of a group of near copies comes first). Links are confirmed on full shingle sets and contracted
to components. Classes of a bucket that are still outside its main component are then compared with
the other components exactly: in small buckets by pairs, in large ones by tiles of bounded size that
hold sets of one group key, count intersections by matrix products and give a spanning forest of the
links. So no link that a table proposes is left unchecked where it matters.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; one or two
words are one shingle; repeated rows are copies of each other; a null doc_id is kept and never names
a component unless all its members are null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import WORD, Scratch, fresh, own_columns, placed as numbered, salted_join, split_join, text_or_empty
from tarnspark.llm.components import components

GROUPS, ROWS = 8, 2
#: Pivots of a bucket; largest bucket that is compared by pairs; sets on a side of a tile.
PIVOTS, SMALL, SIDE = 4, 32, 512
#: Shingles on a side of a tile, texts or sets that a Python worker gets at once, words whose hashes it holds.
ITEMS, BATCH, VOCABULARY = 1 << 19, 1000, 200_000
U = np.uint64
_K = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def shingles(text: str, k: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of the lower-cased text."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), len(words))] if words else [], dtype=U)
    if len(seen) > VOCABULARY:
        seen.clear()
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), dtype=U, count=len(words))
    x = np.zeros(len(words) - k + 1, dtype=U)
    for i in range(k):
        x = (x + h[i : len(h) - k + 1 + i]) * _K[i % 3]
        x ^= x >> U(31)
    return np.unique(x)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**64, n, dtype=U), rng.integers(0, 2**64, n, dtype=U) | U(1)


def minhashes(s: np.ndarray, salt: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Least value of the set under each hash; in slices, so a very long text needs no wide matrix."""
    out = np.full(len(salt), np.iinfo(U).max, dtype=U)
    for i in range(0, len(s), 16_384):
        x = (s[None, i : i + 16_384] ^ salt[:, None]) * odd[:, None]
        x ^= x >> U(32)
        out = np.minimum(out, x.min(axis=1))
    return out


def signatures(docs: DataFrame, k: int, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """doc_id, th, n_shingles, sig (128-bit digest of the set), bands (2 * groups group keys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        salt, odd = seeds(2 * groups * rows)
        for pdf in batches:
            out = []
            for d, h, t in zip(pdf["doc_id"], pdf["th"], pdf["text"]):
                s = shingles(t, k, seen)
                bands = None
                if len(s):
                    m = minhashes(s, salt, odd).reshape(2 * groups, rows)
                    x = np.zeros(2 * groups, dtype=U)
                    for r in range(rows):
                        x = (x + m[:, r]) * _K[r % 3]
                        x ^= x >> U(29)
                    bands = x.astype(np.int64)
                out.append((d, h, len(s), xxhash.xxh3_128_digest(s.tobytes()), bands))
            yield pd.DataFrame(out, columns=["doc_id", "th", "n_shingles", "sig", "bands"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, th long, n_shingles long, sig binary, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """sig, items: the whole shingle set of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                sets = [shingles(t, k, seen) for t in pdf["text"].iloc[i : i + 256]]
                yield pd.DataFrame({"sig": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "items": [s.astype(np.int64) for s in sets]})

    return docs.select("text").mapInPandas(run, "sig binary, items array<long>")


def tile_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the links between two lists of sets (sig, label, items), given the components they are in."""
    out: list[tuple[bytes, bytes]] = []
    if len(left) and len(right):
        items = [*left["items"], *right["items"]]
        size = np.array([len(x) for x in items])
        vocabulary, at, df = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = np.cumsum(df > 1) - 1
        use, row = df[at] > 1, np.repeat(np.arange(len(items)), size)
        row, col, nl = row[use], shared[at[use]], len(left)
        both = np.zeros((nl, len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(shared[-1]) + 1, 4096):
            part = slice(*np.searchsorted(col, [lo, lo + 4096]))
            m = np.zeros((len(items), 4096), np.float32)
            m[row[part], col[part] - lo] = 1
            both += m[:nl] @ m[nl:].T
        union = size[:nl, None] + size[None, nl:] - both
        near = 100 * both >= percent * union
        comp = pd.factorize(pd.concat([left["label"], right["label"]]))[0]
        sig = [*left["sig"], *right["sig"]]
        for i in np.flatnonzero(near.any(axis=1)):
            js = nl + np.flatnonzero(near[i])
            for c, j in zip(*np.unique(comp[js], return_index=True)):
                if c != comp[i]:
                    out.append((sig[i], sig[js[j]]))
                    comp[comp == c] = comp[i]
    return pd.DataFrame(out, columns=["a", "b"])


def each_tile(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """``tile_links`` of every tile, of rows (tile, left, sig, label, items) that come in the order of tiles."""

    def of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        return tile_links(rows[rows["left"]], rows[~rows["left"]], percent)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        for tile, rows in pdf.groupby("tile", sort=True):
            if held and held[0]["tile"].iloc[0] != tile:
                yield of(held)
                held = []
            held.append(rows)
    if held:
        yield of(held)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, groups: int = GROUPS, rows: int = ROWS, internal: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id: links where 100 * intersection >= percent * union.

    ``internal`` adds th, a hash of the text, and label, which names the component (null without words).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    signed = scratch.keep(signatures(docs, k, groups, rows), BATCH)
    classes = scratch.keep(signed.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max(F.struct("n_shingles", "bands")).alias("x")).select("sig", "rep", F.col("x.n_shingles").alias("n"), "x.bands"))
    keys = F.array(*[F.xxhash64(F.lit(i * groups + j), F.get("bands", F.lit(i)), F.get("bands", F.lit(groups + j))) for i in range(groups) for j in range(groups)])
    rows_ = classes.select("sig", "n", F.explode(keys).alias("key"))
    crowded = scratch.keep(rows_.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    members = scratch.keep(split_join(rows_, crowded, "key", "c").select("key", "sig", "n", "c"))
    company = scratch.keep(members.groupBy("sig").agg(F.sum("c").alias("company")))

    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"

    def stars() -> DataFrame:
        of = members.join(company, "sig")
        orders = [F.min(F.struct((-F.col("company") if i == 0 else F.xxhash64(F.lit(i), "sig")).alias("o"), "sig", "n")).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = of.groupBy("key").agg(F.first("c").alias("most"), *orders).select("key", "most", F.array_distinct(F.array(*[F.struct(f"p{i}.sig", f"p{i}.n") for i in range(PIVOTS)])).alias("ps"))
        met = split_join(members, scratch.keep(pivots), "key", "most").select("sig", "n", F.explode("ps").alias("p"))
        return met.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("p.sig").alias("b"), F.col("p.n").alias("nb"))

    def sets_of(named: DataFrame) -> DataFrame:
        """sig, items of the classes named, from the text of one document each."""
        named = scratch.keep(named.distinct().join(classes.select("sig", "rep"), "sig"))
        texts = docs.join(named.select(F.col("rep").alias("_rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
        return scratch.keep(full_sets(texts, k).join(named.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), BATCH)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among the proposed pairs, on full sets of the classes involved."""
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        pairs = scratch.keep(pairs.where(F.col("a") != F.col("b")).where(near).select(lo.alias("a"), hi.alias("b")).distinct())
        sets = sets_of(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))))
        # the class that has the most pairs, a pivot as a rule, may have any number: its set is copied, its pairs are dealt
        one = salted_join(pairs, sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a", "b")
        crowd = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_c"))
        two = salted_join(one, sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b", "a", crowd)
        common = F.size(F.array_intersect("x", "y"))
        links = scratch.keep(two.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u")).where(f"100 * i >= {percent} * u").select("a", "b"))
        scratch.drop(sets)
        return links

    def by_tiles(outside: DataFrame, labelled: DataFrame) -> DataFrame:
        """Links of the classes ``outside`` with any class of another component that shares a group key of the first collection."""
        bands = classes.join(labelled, "sig").select("sig", "label", "n", "bands").join(outside.withColumn("out", F.lit(True)), "sig", "left")
        keyed = bands.select("sig", "label", "n", F.coalesce("out", F.lit(False)).alias("out"), F.posexplode(F.slice("bands", 1, groups)).alias("g", "band"))
        by = keyed.groupBy("g", "band").agg(F.count(F.lit(1)).alias("c"), F.count_if("out").alias("o"), F.sum("n").alias("cn"), F.sum(F.when(F.col("out"), F.col("n"))).alias("on"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("o > 0 and l0 <> l1")
        blocks = lambda n: F.ceil(F.greatest(F.col(n) / SIDE, F.col(n + "n") / ITEMS)).cast("long")
        by = by.select("g", "band", blocks("o").alias("no"), blocks("c").alias("nc")).withColumn("tiles", F.col("no") * F.col("nc"))
        # tiles are numbered, those of the largest group keys first, and dealt in turn: no task gets two large ones more than another
        by = numbered(by, [F.desc("tiles"), "g", "band"], scratch, "t0", of="tiles").drop("tiles")
        keyed = scratch.keep(keyed.join(by, ["g", "band"]))
        sets = sets_of(keyed.select("sig"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("sig"), F.col(n))
        x = keyed.where("out").withColumn("i", mine("no")).withColumn("j", every("nc")).withColumn("left", F.lit(True))
        y = keyed.withColumn("j", mine("nc")).withColumn("i", every("no")).withColumn("left", F.lit(False))
        named = x.unionByName(y).select((F.col("t0") + F.col("i") * F.col("nc") + F.col("j")).alias("tile"), "left", "sig", "label")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = named.join(sets, "sig").repartitionById(parts, F.pmod("tile", F.lit(parts)).cast("int")).sortWithinPartitions("tile")
        links = dealt.mapInPandas(lambda batches: each_tile(batches, percent), "a binary, b binary")
        links = scratch.keep(links.distinct(), BATCH)
        scratch.drop(sets)
        return links

    links = confirmed(stars())
    found = components(links, "a", "b", scratch)
    labelled = scratch.keep(company.select("sig").join(found.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    placed = members.join(labelled, "sig")
    by = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = by.groupBy("key").agg(F.max(F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("all")).where("k > 1").select("key", "all", F.col("main.label").alias("main"))
    placed = scratch.keep(split_join(placed, scratch.keep(mixed), "key", "all").select("key", "sig", "n", "c", "label", "main"))
    x = placed.where(f"label != main and c <= {SMALL}").select("key", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = placed.where(f"c <= {SMALL}").select("key", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    more = confirmed(x.join(y, "key").where("la != lb").select("a", "na", "b", "nb"))
    outside = scratch.keep(placed.where(f"label != main and c > {SMALL}").select("sig").distinct())
    if outside.limit(1).count():
        more = more.unionByName(by_tiles(outside, labelled))
    if more.limit(1).count():
        found = components(links.unionByName(more), "a", "b", scratch)
    labels = classes.select("sig", "rep").join(found.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = scratch.keep(labels.join(least, "label").select("sig", "label", F.col("rep").alias("class_id"), "component_id"))
    for kept in (members, classes):
        scratch.drop(kept)
    out = signed.select("doc_id", "th", "n_shingles", "sig").join(placed, "sig", "left")
    alone = F.col("n_shingles") == 0
    named = {c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")}
    more = ["th", "label"] if internal else []
    return out.select("doc_id", "n_shingles", named["component_id"], F.col("doc_id").eqNullSafe(named["component_id"]).alias("kept"), named["class_id"], *more)


def distinct_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id (then text hash), columns as they were.

    Rows equal in doc_id and text are copies: one stays. Documents without words are no copies of
    anything and all stay.
    """
    has_words = text_or_empty().rlike(WORD)
    th = F.xxhash64(text_or_empty())
    found = near_duplicates(docs, k, percent, internal=True).where("label is not null")
    id_, th_, n_, key = fresh(docs, "_id", "_th", "_n", "_key")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("x"), F.count(F.lit(1)).alias(n_))
    first = Scratch(docs.sparkSession).keep(first.select(F.col("x.doc_id").alias(id_), F.col("x.th").alias(th_), n_))
    once = docs.where(has_words).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (th == F.col(th_)))
    # a group's first document may itself be there several times
    several = once.where(F.col(n_) > 1).withColumn(key, th).dropDuplicates(["doc_id", key])
    cols = own_columns(docs)
    return once.where(F.col(n_) == 1).select(*cols).unionByName(several.select(*cols)).unionByName(docs.where(~has_words).select(*cols))

"""Op 6: line dedup by a log-template tree.

A line is parsed at fixed depth: its token count, its leading tokens (tokens with digits, addresses and
links are variable fields, "<*>"), then a leaf. In the leaf a line stands for its exact template and for
generalised ones in which a stretch of the remaining tokens is a variable field: lines of ``WIDE`` tokens
or more with one quarter of them variable, lines of ``NARROW`` or more with any ``GAP`` neighbouring ones.

A template's documents are counted, distinct by doc_id and a hash of the text. It recurs from
``SHORT_DOCS`` on, lines of ``LONG`` tokens from ``LONG_DOCS``, an exact template of ``PASSAGE`` words from
``PASSAGE_DOCS``. Whole copies are near-dedup's business and count as one: a document is a copy if nearly
all its words stand in lines whose branch of the tree (token count and the first, or the last, ``LEAD``
tokens) other documents hold too; then it counts as the document that first holds the most of its words.
A document with a line of its own is never a copy, however many lines it shares; neither is a document
of one line.

A line is dropped if it has a recurring template, unless it is the first (least doc_id, hash, line) of
any of its recurring templates or of an exact template that two or more documents hold. So what several
documents state stays once; a line whose variable fields no other document has may go for good, as
generalising means.

Counts are grouped sums with map-side combining. Joins by template send the few most frequent templates
to every task (a number bounded whatever the corpus) and the rest through a shuffle in which no template
is frequent.

Defined cases: null text has no lines and stays null; blank lines are never dropped; a line of fewer
than ``LEAD`` tokens that are all variable fields (a number, an unspaced sentence with a digit) stands
for its own text; rows equal in doc_id and text are one document; ties go by doc_id, a hash of the text
and the line number; extra columns are kept by ``deduplicated``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import SPACE, Scratch, fresh, let, split_join, text_or_empty

LEAD = 3
#: Tokens from which on a line has generalised templates: any GAP neighbouring tokens, or one quarter.
NARROW, GAP, WIDE = 6, 2, 12
#: Documents, copies counted once, from which on a template recurs, for lines of at least LONG tokens and for shorter ones.
LONG, LONG_DOCS, SHORT_DOCS = 20, 3, 8
#: Words from which on a line's exact template recurs from this many documents on.
PASSAGE, PASSAGE_DOCS = 50, 2
#: A document has lines of its own if they make up this many words and this share of its words.
OWN_WORDS, OWN_SHARE = 8, 0.05
VARIABLE = r"[0-9@]|^[a-z]+://"
#: A line without any of these and without "://" has no variable field and no white space but spaces.
ODD = r"[0-9@\x09-\x0D]"
#: Kinds of keys: exact template, generalised ones, and the branches by first and by last tokens.
EXACT, GENERAL, HEAD, TAIL = 0, 1, 2, 3


def keys_of(s: Column, n: Column) -> Column:
    """array<(kind, key)> of a line's tokens, joined, and their number: its two branches, the exact template, the generalised ones.

    Tokens are cut out of the text, as each slice of an array copies the whole array. A line of WIDE tokens
    is cut in halves and these in quarters; its templates are hashes of the hashes of their quarters.
    """
    cut = lambda x, k: F.call_function("substring_index", x, F.lit(" "), k)  # noqa: E731  the first k tokens, or the last -k
    named = lambda kind, *parts: F.struct(F.lit(kind).cast("byte").alias("kind"), F.xxhash64(F.lit(kind), n, *parts).alias("key"))
    least = F.least(F.lit(LEAD), n)
    branches = F.array(named(HEAD, cut(s, least)), named(TAIL, cut(s, -least)))
    exact = F.array(named(EXACT, s))

    edge = lambda j: F.shiftright((n - LEAD) * j, 2) + LEAD
    halves = F.struct(cut(s, edge(2)).alias("a"), cut(s, edge(2) - n).alias("b"))
    lead = lambda h: cut(h["a"], F.lit(LEAD))
    quarters = lambda h: [cut(cut(h["a"], edge(1)), LEAD - edge(1)), cut(h["a"], edge(1) - edge(2)), cut(h["b"], edge(3) - edge(2)), cut(h["b"], edge(3) - n)]
    hashes = lambda h: F.struct(F.xxhash64(lead(h)).alias("lead"), *[F.xxhash64(q).alias(f"q{j}") for j, q in enumerate(quarters(h))])
    less = lambda p, gone: [p["lead"], *[p[f"q{j}"] for j in range(4) if j != gone]]
    wide = let(let(halves, hashes), lambda p: F.array(named(EXACT, *less(p, None)), *[named(GENERAL, F.lit(j), *less(p, j)) for j in range(4)]))
    gaps = F.transform(F.sequence(F.lit(GAP), n - GAP), lambda i: named(GENERAL, i, cut(s, i), cut(s, i + GAP - n)))
    return F.when(n >= WIDE, F.concat(branches, wide)).when(n >= NARROW, F.concat(branches, exact, gaps)).when(n > 0, F.concat(branches, exact))


def template(l: Column) -> Column:
    """A line's tokens, variable fields masked, with one space between them."""
    words = F.array_remove(F.split(l, f"[{SPACE}]+"), "")
    masked = lambda w: F.transform(w, lambda t: F.when(t.rlike(VARIABLE), "<*>").otherwise(t))
    bare = lambda w: (F.size(w) < LEAD) & F.forall(w, lambda t: t.rlike(VARIABLE))
    as_is = ~(l.rlike(ODD) | l.contains("://") | l.contains("  ") | l.startswith(" ") | l.endswith(" "))
    return F.when(as_is, l).otherwise(F.array_join(let(words, lambda w: F.when(bare(w), w).otherwise(masked(w))), " "))


def parsed(text: Column) -> Column:
    """array<(n, keys)>: token count and keys of every line in order, no keys for a blank one."""
    n = lambda s: F.when(s == "", 0).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1)
    counted = lambda l: let(template(l), lambda s: F.struct(s.alias("s"), n(s).alias("n")))
    line = lambda l: let(counted(l), lambda t: F.struct(t["n"].alias("n"), keys_of(t["s"], t["n"]).alias("keys")))
    return F.transform(F.split(text, "\n"), line)


def lines_of(docs: DataFrame) -> DataFrame:
    """who, doc_id, th, words (of the document), line, n, keys: a row for every line that is not blank.

    One expression, bound step by step: written as columns of their own, the lines would be parsed anew
    for each use.
    """
    total = lambda ls: F.aggregate(ls, F.lit(0).cast("long"), lambda a, l: a + l["n"])
    solid = lambda ls: F.size(F.filter(ls, lambda l: l["n"] > 0))
    rows = lambda ls: F.filter(F.transform(ls, lambda l, i: F.struct(i.alias("line"), l["n"].alias("n"), l["keys"].alias("keys"))), lambda l: l["n"] > 0)
    one = let(parsed(F.col("text")), lambda ls: F.struct(total(ls).alias("words"), solid(ls).alias("solid"), rows(ls).alias("rows")))
    exploded = docs.select("doc_id", "th", F.inline(F.array(one))).select("doc_id", "th", "words", "solid", F.explode("rows").alias("l"))
    return exploded.select(F.xxhash64("doc_id", "th").alias("who"), "doc_id", "th", "words", "solid", "l.line", "l.n", "l.keys")


def need() -> Column:
    """Documents that make a template recur, from its kind and the line's length."""
    return F.when((F.col("n") >= PASSAGE) & (F.col("kind") == EXACT), PASSAGE_DOCS).when(F.col("n") >= LONG, LONG_DOCS).otherwise(SHORT_DOCS)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, drop: numbers of the lines to drop, for the documents that have any."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(lines_of(docs))
    every = lines.select("who", "doc_id", "th", "words", "solid", "line", "n", F.explode("keys").alias("k")).select("who", "doc_id", "th", "words", "solid", "line", "n", "k.kind", "k.key")
    # a key's documents and its first line: copies of a row and repeats inside a document count once
    by_doc = every.groupBy("key", "doc_id", "th").agg(F.min("line").alias("line"))
    by = by_doc.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "th", "line")).alias("first"))
    shared = scratch.keep(by.where("docs > 1").select("key", "docs", F.col("first.doc_id").alias("f_doc"), F.xxhash64("first.doc_id", "first.th").alias("f_who"), F.col("first.line").alias("f_line")))
    hits = split_join(every, shared, "key", "docs")
    hits = scratch.keep(hits.select("who", "doc_id", "th", "words", "solid", "line", "n", "kind", "key", "docs", "f_doc", "f_who", ((F.col("who") == F.col("f_who")) & (F.col("line") == F.col("f_line"))).alias("is_first")))
    scratch.drop(lines)
    scratch.drop(shared)
    same = scratch.keep(copies(hits))
    able = hits.where(f"kind = {GENERAL} or kind = {EXACT}").where(F.col("docs") >= need())
    counted = able.select("who", "key", need().alias("need")).join(same, "who", "left").select("key", "need", F.coalesce("as", "who").alias("who"))
    recurring = counted.groupBy("key", "need", "who").agg(F.lit(1).alias("one")).groupBy("key", "need").agg(F.count(F.lit(1)).alias("c")).where("c >= need").select("key", F.col("c").alias("r_c"))
    recurring = scratch.keep(recurring)
    of = split_join(able.select("doc_id", "th", "line", "is_first", "key"), recurring, "key", "r_c").select("doc_id", "th", "line", F.lit(True).alias("recurs"), "is_first")
    firsts = hits.where(f"kind = {EXACT} and is_first").select("doc_id", "th", "line", F.lit(False).alias("recurs"), "is_first")
    told = of.unionByName(firsts).groupBy("doc_id", "th", "line").agg(F.max("recurs").alias("recurs"), F.max("is_first").alias("is_first"))
    out = scratch.keep(told.where("recurs and not is_first").groupBy("doc_id", "th").agg(F.collect_set("line").alias("drop")))
    for done in (hits, same, recurring):
        scratch.drop(done)
    return out


def copies(hits: DataFrame) -> DataFrame:
    """who, as: the documents without lines of their own that are no single line, each with the one it copies.

    That is the document which first holds the branches of the most of its words (ties: least doc_id, hash).
    """
    branch = hits.where(f"kind = {HEAD} or kind = {TAIL}").where("solid > 1")
    known = branch.groupBy("who", "words", "line", "n").agg(F.min("kind").alias("kind")).groupBy("who", "words").agg(F.sum("n").alias("shared"))
    own = F.col("words") - F.col("shared")
    without = known.where((own < OWN_WORDS) | (own < OWN_SHARE * F.col("words"))).select(F.col("who").alias("w"))
    # of a document's lines each counts for one branch, by preference the first
    held = branch.groupBy("who", "line", "n").agg(F.min(F.struct("kind", "f_doc", "f_who")).alias("f")).select("who", "n", "f.f_doc", "f.f_who")
    by = held.groupBy("who", "f_doc", "f_who").agg(F.sum("n").alias("n")).groupBy("who").agg(F.min(F.struct((-F.col("n")).alias("n"), "f_doc", "f_who"))["f_who"].alias("as"))
    return by.join(without, F.col("who") == F.col("w"), "left_semi")


def marked(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The rows of ``docs`` joined with their decisions; numbers of the lines to drop (or null); the text without them."""
    th = F.xxhash64(text_or_empty())
    id_, th_, drop = fresh(docs, "_id", "_th", "_drop")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), th.alias("th")).where("text <> ''")
    found = dropped_lines(thin).select(F.col("doc_id").alias(id_), F.col("th").alias(th_), F.col("drop").alias(drop))
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (th == F.col(th_)), "left")
    kept = F.filter(F.split("text", "\n"), lambda l, i: ~F.array_contains(drop, i))
    return joined, F.col(drop), F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text without the dropped lines."""
    joined, drop, rest = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = F.when(text_or_empty() == "", 0).otherwise(F.size(F.split("text", "\n")))
    return joined.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"), rest.alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with recurring lines dropped, columns as they were; those left without any word go."""
    joined, drop, rest = marked(docs)
    (new,) = fresh(joined, "_new")
    joined = joined.withColumn(new, rest).where(drop.isNull() | F.col(new).rlike(f"[^{SPACE}]"))
    replaced = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(drop.isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[replaced.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

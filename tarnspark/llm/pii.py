"""Op 1 [native]: personal data by generated candidates, boosted trees and calibrated thresholds.

Base spans come from fixed patterns with validity checks and are always kept. Wider generators then
propose spans in what the base spans leave of the text: unusual and obfuscated e-mail addresses,
numbers in phone and card formats without the base marks, IPv6 addresses. Each candidate gets format
and context features; gradient-boosted trees of depth two score it, and a threshold for each kind,
calibrated on held-out examples for precision, decides whether it is added.

The trees are fitted on examples made by rule (``examples``, a bounded number), whose features come
from the same expressions as those of the documents; the model becomes one CASE expression. On the
main path everything is array expressions on the row: no shuffle and no Python.

Defined cases: null text is empty and has no spans; kinds are matched independently, so spans of
different kinds may overlap; positions are code points, end exclusive; repeated rows give repeated
result rows; an empty table gives no rows; extra columns are ignored. The patterns below give the
matches of the plain patterns, written with possessive repeats and anchors so that each is linear in
the length of the text.
"""

from __future__ import annotations

import json
import math
import random
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm.common import let, prefix_sums, text_or_empty

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[\p{L}\p{N}-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[\p{L}\p{N}-]{2,}+)++)",
    "ip": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}|[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4})(?![\p{L}\p{N}:])",
    "num": r"(?<![\p{L}\p{N}.,])\+?+[0-9(](?:[()./\x20-]*+[0-9]){5,}+(?![\p{L}\p{N}])",
}
#: Cheap tests that a text must pass before a pattern is run on it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"@|[\[(]at[\])]|\x20dot\x20", "ip": r"[0-9A-Fa-f]:", "num": r"[0-9(][0-9()./\x20-]{5}"}

SPAN = "array<struct<start:int,end:int,s:string>>"
CONTEXT = 32
#: Words that speak for a kind, or for another meaning of a number.
HINTS = (
    (1, r"(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|tél|handy)[^\p{L}]{0,4}(?:\p{L}{1,8}\x20)?$"),
    (2, r"(?:card|visa|amex|mastercard|credit|debit|karte|carte|tarjeta)[^\p{L}]{0,4}(?:\p{L}{1,8}\x20)?$"),
    (3, r"(?:mail|contact|write to|reach|courriel|correo)[^\p{L}]{0,4}(?:\p{L}{1,8}\x20)?$"),
    (4, r"(?:address|host|server|ipv6|ip|gateway)[^\p{L}]{0,4}(?:\p{L}{1,8}\x20)?$"),
    (5, r"(?:order|invoice|version|ref|isbn|issn|page|pages|no|id|serial|build|section|date|time|at|mac|ticket|part)[^\p{L}]{0,4}$"),
)
SHAPES = (
    r"\(?0{0,2}[0-9]{1,3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}",
    r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    r"0[0-9]{2,4}[ /.-][0-9 ]{5,10}",
    r"00[ ]?[1-9][0-9]{0,2}([ .-]?[0-9]){7,12}",
    r"[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}",
    r"[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}",
    r"[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}( [0-9]{1,2})?",
    r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}( [0-9]{1,2})?",
    r"97[89][ -][0-9 -]{10,14}",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"[0-9]{13,19}",
    r"[0-9]{7,12}",
)
#: Leading digits and lengths of card issuers.
ISSUERS = (r"3[47][0-9]{13}", r"4(?:[0-9]{12}|[0-9]{15})", r"(?:5[1-5]|2[2-7])[0-9]{14}", r"3[068][0-9]{12}", r"6[0-9]{15,18}")
#: A generator for each shape: numbers inside a longer run of digits and separators.
INNER = tuple(rf"(?<![\p{{L}}\p{{N}}.,])(?:{p})(?![\p{{L}}\p{{N}}])" for p in SHAPES)
FEATURES = ("kind", "digits", "groups", "shape", "luhn", "hint", "before", "plain", "colons", "issuer")


def spans(text: Column, pattern: str, needs: str) -> Column:
    """All matches with positions, from what lies between them; lengths add up by two-level prefix sums."""
    p = F.lit(pattern)

    def at(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: (F.length(F.get(x["gap"], i)) + F.when(i > 0, F.length(F.get(x["m"], i - 1))).otherwise(0)).cast("int"))
        return let(
            F.struct(steps.alias("d"), prefix_sums(steps).alias("b")),
            lambda s: F.transform(x["m"], lambda m, i: F.struct((F.get(s["b"], i) + F.get(s["d"], i)).alias("start"), (F.get(s["b"], i) + F.get(s["d"], i) + F.length(m)).alias("end"), m.alias("s"))),
        )

    found = let(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), at)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(SPAN))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def valid(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    if kind == "ip":
        return s.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(digits_of(s))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans(text, BASE[kind], NEEDS[kind]), lambda x: valid(kind, x["s"]))


def _masked(kind: str, text: Column) -> Column:
    """The text with its valid base spans blanked, positions unchanged."""
    found = let(
        F.struct(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)).alias("m"), F.split(text, BASE[kind], -1).alias("gap")),
        lambda x: F.array_join(F.transform(x["gap"], lambda g, i: F.concat(g, let(F.coalesce(F.get(x["m"], i), F.lit("")), lambda m: F.when(valid(kind, m), F.repeat(F.lit("\n"), F.length(m))).otherwise(m)))), ""),
    )
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(text)


def featured(text: Column, c: Column, kind: Column) -> Column:
    d = digits_of(c["s"])
    before = F.lower(F.substring(text, F.greatest(F.lit(1), c["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), c["start"])))
    pick = lambda pairs, x: F.coalesce(*[F.when(x.rlike(p), v) for v, p in pairs], F.lit(0))
    mark = F.substring(before, -1, 1)
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        kind.cast("int").alias("kind"),
        F.least(F.length(d), F.lit(20)).alias("digits"),
        F.least(F.size(F.split(F.trim(c["s"]), r"[^\p{L}\p{N}]+")), F.lit(9)).alias("groups"),
        pick([(i + 1, f"^{p}$") for i, p in enumerate(SHAPES)], c["s"]).alias("shape"),
        F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False).cast("int").alias("luhn"),
        pick(HINTS, before).alias("hint"),
        F.when(mark == "", 0).when(mark.rlike(r"\s"), 1).when(mark.rlike("[#$€£=/_@%&*]"), 2).otherwise(3).alias("before"),
        F.when(c["s"].rlike("[@]"), 1).when(c["s"].rlike(r"[\[(]at[\])]"), 2).when(c["s"].rlike(r" at .* dot "), 3).otherwise(0).alias("plain"),
        F.when(c["s"].contains("::"), 9).otherwise(F.least(F.length(c["s"]) - F.length(F.replace(c["s"], F.lit(":"), F.lit(""))), F.lit(8))).alias("colons"),
        pick([(i + 1, f"^{p}$") for i, p in enumerate(ISSUERS)], d).alias("issuer"),
    )


def candidates(text: Column) -> Column:
    """Overlapping proposals with features: a run of digits and every number of a known shape in it, each as a card and as a phone."""

    def of(t: Column) -> Column:
        as_ = lambda found, kind: F.transform(found, lambda c: featured(t, c, F.lit(kind)))
        named = lambda gen, kind: as_(spans(t, WIDE[gen], WIDE_NEEDS[gen]), kind)
        inner = F.when(t.rlike(WIDE_NEEDS["num"]), F.concat(*[spans(t, p, p) for p in INNER])).otherwise(F.array().cast(SPAN))
        numbers = F.array_distinct(F.concat(spans(t, WIDE["num"], WIDE_NEEDS["num"]), inner))
        return F.concat(named("email", 0), named("ip", 1), let(numbers, lambda n: F.concat(as_(n, 2), as_(n, 3))))

    # the widest kinds first, so that no blank falls inside a span still to be found
    rest = text
    for kind in ("phone", "card", "email", "ip"):
        rest = let(rest, partial(_masked, kind))
    maybe = text.rlike("|".join(WIDE_NEEDS.values()))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,digits:int,groups:int,shape:int,luhn:int,hint:int,before:int,plain:int,colons:int,issuer:int>>")
    return F.when(maybe, let(rest, of)).otherwise(empty)


# --- model -----------------------------------------------------------------------------------------

N_EXAMPLES = 1200
ROUNDS = 24
RATE = 0.4
PRECISION = 0.98
#: Accepted candidates on each side, by kind and place, that one is compared with.
NEIGHBOURS = 24


def _card(r: random.Random, n: int, start: str) -> str:
    d = start + "".join(r.choice("0123456789") for _ in range(n - len(start) - 1))
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
    return d + str(-total % 10)


def examples(n: int = N_EXAMPLES) -> list[dict]:
    """Texts by rule with one item each: its kind, place and whether it is personal data."""
    r = random.Random(7)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hex_ = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9)))
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es"])
    wrong = lambda c: c[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)
    nz = lambda: r.choice("23456789")
    card15 = lambda: _card(r, 15, r.choice(["34", "37"]))
    card16 = lambda: _card(r, 16, r.choice(["4", "51", "55", "6011"]))
    phone_words, card_words, mail_words, ip_words, id_words = ["call", "phone:", "tel.", "mobile", "fax"], ["card", "visa", "credit card:"], ["mail", "contact", "write to"], ["address", "host", "ip"], ["order", "invoice", "version", "ref", "id", "isbn", "page"]
    good = [
        (3, lambda: f"({nz()}{dig(2)}) {nz()}{dig(2)}-{dig(4)}", phone_words, 0.6), (3, lambda: f"{nz()}{dig(2)}-{nz()}{dig(2)}-{dig(4)}", phone_words, 0.8), (3, lambda: f"0{dig(3)} {dig(7)}", phone_words, 0.95),
        (3, lambda: f"00{nz()}{dig(1)} {dig(3)} {dig(6)}", phone_words, 0.8), (2, lambda: (lambda c: f"{c[:4]} {c[4:10]} {c[10:]}")(card15()), card_words, 0.7), (2, card15, card_words, 0.9),
        (2, lambda: (lambda c: ".".join(c[i : i + 4] for i in (0, 4, 8, 12)))(card16()), card_words, 0.7), (0, lambda: f"{word()}é@{word()}ö.{tld()}", mail_words, 0.5), (0, lambda: f"{word()} [at] {word()} [dot] {tld()}", mail_words, 0.5),
        (0, lambda: f"{word()}(at){word()}(dot){tld()}", mail_words, 0.5), (0, lambda: f"{word()} at {word()} dot {tld()}", mail_words, 0.7), (1, lambda: f"2001:{hex_(3)}::{hex_(4)}:{hex_(4)}", ip_words, 0.6), (1, lambda: ":".join(hex_(4) for _ in range(8)), ip_words, 0.6),
    ]
    bad = [
        (3, lambda: f"{dig(4)}-{dig(2)}-{dig(2)}", id_words, 0.3), (3, lambda: f"{dig(2)}.{dig(2)}.{dig(4)}", id_words, 0.3), (3, lambda: f"{dig(1)}.{dig(2)}.{dig(3)}-{dig(2)}", id_words, 0.5), (3, lambda: f"978-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}", id_words, 0.6),
        (3, lambda: dig(r.randint(7, 12)), id_words, 0.5), (2, lambda: dig(r.randint(13, 19)), id_words, 0.4), (3, lambda: f"{nz()}{dig(2)}-{nz()}{dig(2)}-{dig(4)}", id_words, 1.0), (2, lambda: " ".join(dig(4) for _ in range(4)), id_words, 0.4),
        (3, lambda: f"{dig(2)} {dig(3)} {dig(2)} {dig(1)}", id_words, 0.2), (3, lambda: f"{dig(3)}/{dig(3)} {dig(3)}", id_words, 0.2), (3, lambda: f"{dig(3)}-{dig(2)}-{dig(4)}", id_words, 0.4), (2, lambda: f"{dig(5)}-{dig(5)}-{dig(5)}", id_words, 0.4),
        (1, lambda: ":".join(dig(2) for _ in range(3)), ["at", "time"], 0.4), (1, lambda: ":".join(hex_(2) for _ in range(6)), ["mac", "id"], 0.4), (0, lambda: f"{word()}@{word()}{r.choice(['.1', '.x'])}{dig(2)}", id_words, 0.4), (0, lambda: f"{word()} at {word()}.{word()}", ["the", "a"], 0.3), (0, lambda: f"the {word()} at {word()} dot dot", ["the"], 0.3),
        (2, lambda: wrong(card16()), card_words, 0.5), (2, lambda: wrong(card15()), card_words, 0.5), (2, lambda: (lambda c: " ".join(c[i : i + 4] for i in (0, 4, 8, 12)))(wrong(card16())), card_words, 0.5),
        (3, lambda: wrong(card16()), ["", "a"], 0.5), (3, lambda: ".".join(str(r.randint(100, 999)) for _ in range(4)), ip_words, 0.5), (3, lambda: f"{dig(1)}.{dig(2)}.{dig(1)}.{dig(4)}", id_words, 0.5),
    ]
    out = []
    for i in range(n):
        kind, make, hints, share = r.choice(good if i % 2 else bad)
        lead = " ".join(word() for _ in range(r.randint(1, 5))) + " " + (r.choice(hints) + " " if r.random() < share else "")
        item = make()
        out.append({"id": i, "text": lead + item + r.choice([" ", ", ", ".\n", ""]) + word(), "kind": kind, "low": len(lead), "high": len(lead) + len(item), "label": i % 2})
        if out[-1]["text"][out[-1]["high"] :][:1].isalnum():
            out[-1]["text"] = out[-1]["text"][: out[-1]["high"]]
    return out


def boost(rows: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees (f, v, g, u, h, w, four leaf values): split on f = v, then on g = u or on h = w; Newton leaves on logistic loss."""
    score = [0.0] * len(rows)
    width = len(FEATURES)
    values = [sorted({x[f] for x, _ in rows}) for f in range(width)]
    tests = [(f, v) for f in range(width) for v in values[f]]
    trees = []
    for _ in range(rounds):
        g = [y - 1 / (1 + math.exp(-s)) for (_, y), s in zip(rows, score)]
        h = [max(1e-6, abs(e) * (1 - abs(e))) for e in g]

        def best(ids: list[int]) -> tuple:
            stat = {t: [0.0, 0.0] for t in tests}
            all_g, all_h = sum(g[i] for i in ids), sum(h[i] for i in ids)
            for i in ids:
                for f, v in enumerate(rows[i][0]):
                    s = stat[f, v]
                    s[0] += g[i]
                    s[1] += h[i]
            gain = lambda s: s[0] ** 2 / (s[1] + 1) + (all_g - s[0]) ** 2 / (all_h - s[1] + 1)
            t = max(tests, key=lambda t: gain(stat[t]))  # the first, of equals
            s = stat[t]
            return *t, rate * s[0] / (s[1] + 1), rate * (all_g - s[0]) / (all_h - s[1] + 1)

        ids = range(len(rows))
        f, v, *_ = best(ids)
        yes, no = best([i for i in ids if rows[i][0][f] == v]), best([i for i in ids if rows[i][0][f] != v])
        trees.append((f, v, yes, no))
        for i in ids:
            score[i] += apply_tree(trees[-1], rows[i][0])
    return trees


def apply_tree(tree: tuple, x: tuple[int, ...]) -> float:
    f, v, yes, no = tree
    g, u, a, b = yes if x[f] == v else no
    return a if x[g] == u else b


def model_expression(trees: list[tuple], c: Column) -> Column:
    side = lambda n: F.when(c[FEATURES[n[0]]] == n[1], F.lit(n[2])).otherwise(F.lit(n[3]))
    total = F.lit(0.0)
    for f, v, yes, no in trees:
        total = total + F.when(c[FEATURES[f]] == v, side(yes)).otherwise(side(no))
    return total


def thresholds(trees: list[tuple], held: list[tuple[tuple[int, ...], int]], precision: float = PRECISION) -> list[float]:
    """For each kind the least score above which held-out examples reach the precision asked for."""
    out = []
    for kind in range(len(KINDS)):
        scored = sorted(((sum(apply_tree(t, x) for t in trees), y) for x, y in held if x[0] == kind), reverse=True)
        good, cut = 0, math.inf
        for i, (s, y) in enumerate(scored):
            good += y
            if good >= precision * (i + 1) and (i + 1 == len(scored) or scored[i + 1][0] < s):
                cut = s
        out.append(max(cut - 1e-9, 0.0))
    return out


def labelled_rows(spark: SparkSession, n: int) -> tuple[list, list]:
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples(n))), "array<struct<id:int,text:string,kind:int,low:int,high:int,label:int>>")).alias("e")).select("e.*")
    found = made.select("id", "kind", "low", "high", "label", F.explode(candidates(F.col("text"))).alias("c")).where("c.start < high and c.end > low").collect()
    whole = lambda r: r["kind"] < 2 or (r["c"]["start"], r["c"]["end"]) == (r["low"], r["high"])
    rows = [(r["id"], tuple(r["c"][f] for f in FEATURES), int(r["label"] and r["c"]["kind"] == r["kind"] and whole(r))) for r in found]
    return [(x, y) for i, x, y in rows if i // 2 % 2], [(x, y) for i, x, y in rows if not i // 2 % 2]


_models: dict[int, tuple] = {}


def fitted(spark: SparkSession, n: int = N_EXAMPLES) -> tuple[list[tuple], list[float]]:
    """Trees and thresholds; fitted once a process from examples that do not depend on the corpus."""
    if n not in _models:
        train, held = labelled_rows(spark, n)
        trees = boost(train)
        _models[n] = trees, thresholds(trees, held)
    return _models[n]


def best(found: Column) -> Column:
    """Of candidates of one kind that overlap, those that no better one overlaps; neighbours in order of place."""
    rank = lambda c: F.struct(c["margin"], c["end"] - c["start"], -c["start"])

    def of(a: Column) -> Column:
        near = lambda i: F.slice(a, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
        beats = lambda c: lambda d: (d["kind"] == c["kind"]) & (d["start"] < c["end"]) & (c["start"] < d["end"]) & (rank(d) > rank(c))
        return F.filter(a, lambda c, i: ~F.exists(near(i), beats(c)))

    return let(F.array_sort(found), of)


def find(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """doc_id, base (spans by kind, as in the patterns), added (kind, start, end of accepted candidates)."""
    trees, cuts = model or fitted(docs.sparkSession)
    t = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    cut = lambda c: F.get(F.array(*[F.lit(float(min(x, 1e9))) for x in cuts]), c["kind"])
    scored = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (model_expression(trees, c) - cut(c)).alias("margin"))
    added = F.filter(F.transform(candidates(F.col("text")), scored), lambda c: c["margin"] >= 0)
    added = best(added)
    return t.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS], added.alias("added"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, redacted: every span found is replaced by its kind in angle brackets; overlapping spans become one mark."""
    found = find(docs)
    mark = lambda name: lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), F.concat(F.lit("<"), name(c), F.lit(">")).alias("k"))
    fixed = lambda k: lambda c: F.lit(k)
    kinds = F.concat(*[F.transform(k, mark(fixed(k))) for k in KINDS], F.transform("added", mark(lambda c: F.get(F.array(*map(F.lit, KINDS)), c["kind"]))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, c: F.when(c["s"] >= acc["at"], F.struct(c["e"].alias("at"), F.concat(acc["out"], F.substring("text", acc["at"] + 1, c["s"] - acc["at"]), c["k"]).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], c["e"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(F.array_sort(kinds), start, step)
    return found.select("doc_id", let(done, lambda d: F.concat(d["out"], F.substring("text", d["at"] + 1, F.length("text")))).alias("redacted"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and digest of the base spans, and all spans as text."""
    at = lambda i: lambda c: F.struct(F.lit(i).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.concat(*[F.transform(k, at(i)) for i, k in enumerate(KINDS)])
    joined = lambda a: F.array_join(F.transform(a, lambda c: F.concat(F.get(F.array(*map(F.lit, KINDS)), c["kind"]), F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))), ",")
    more = F.transform("added", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, more))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )

"""Recurring templates go, one stays, copies of whole documents and rare lines are left alone."""

import re

from pyspark.sql import functions as F

from tarnspark.llm import line_templates as L

LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 5)}" for i in range(40))


def unique(i):
    return " ".join(chr(97 + (i * 7 + j * 3) % 26) * 3 + chr(97 + (i + j) % 26) + chr(97 + i % 26) for j in range(9))


def test_recurring_lines(docs):
    rows = [f"{unique(i)}\n{LONG}\nuser {i} logged in from host{i}.example" for i in range(20)]
    got = {r["doc_id"]: r for r in L.report(docs(rows)).collect()}
    for i in range(20):
        lines = got[i]["text"].split("\n")
        assert lines[0] == unique(i)
        assert (LONG in lines) == (i == 0) and any(x.startswith("user") for x in lines) == (i == 0)
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (3, 0 if i == 0 else 2)


def test_one_variable_quarter(docs):
    head = "the session of the day was closed by".split()
    tail = "after all the items had been sent away again".split()
    rows = [f"{unique(i)}\n{' '.join(head + [chr(97 + i) * 5] + tail)}" for i in range(12)]
    got = L.report(docs(rows)).collect()
    assert sum(r["n_dropped"] for r in got) == 11


def test_copies_and_rare_lines_stay(docs):
    same = "\n".join(unique(i) + " " + unique(i + 1) for i in range(6))
    rows = [same] * 30 + [f"{unique(40 + i)}\n{unique(99)} {unique(98)}" for i in range(2)]
    assert all(r["n_dropped"] == 0 for r in L.report(docs(rows)).collect())


def test_edges(docs, odd):
    df = docs(odd + [f"{LONG}\n{unique(i)}" for i in range(4)] + [LONG], extra=True)
    got = {r["doc_id"]: r for r in L.report(df).collect()}
    assert got[0]["text"] is None and (got[1]["n_lines"], got[1]["text"]) == (0, "")
    out = L.deduplicated(df)
    assert out.columns == df.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    n = len(odd)
    assert kept[n]["text"].startswith(LONG) and kept[n + 1]["text"] == unique(1) == kept[n + 1]["text"] and kept[n + 1]["n_chars"] == len(unique(1))
    assert n + 4 not in kept and kept[0]["text"] is None  # nothing is left of a document that was one recurring line
    assert L.report(df.limit(0)).count() == 0
    twice = docs([(1, LONG, "s"), (1, LONG, "s"), (None, f"{LONG}\nx y z", "s")])
    assert all(r["n_dropped"] == 0 for r in L.report(twice).collect())


def test_short_and_unspaced_lines(docs):
    rows = [f"{unique(i)}\nLes.\nAnd ornd.\n無断転載を禁じます\n{i}\n第{i}章、{chr(0x4E00 + i)}の話\n" for i in range(12)]
    got = {r["doc_id"]: r for r in L.report(docs(rows)).collect()}
    for i in range(12):
        own = f"{unique(i)}\n{i}\n第{i}章、{chr(0x4E00 + i)}の話\n"
        assert got[i]["text"] == (rows[0] if i == 0 else own)  # a number or sentence of one's own is no template


def test_pages_that_share_a_block_count_one_by_one(docs):
    block = [f"{a} {b}" for a in ("Home", "About", "Contact", "Terms") for b in ("page", "menu", "site", "shop", "help")]
    own = [" ".join(chr(97 + (i * 7 + j * 3) % 26) * 2 + chr(97 + (i + j) % 26) + chr(97 + i % 26) for j in range(60)) for i in range(10)]
    rows = ["\n".join([*block, o]) for o in own] + ["\n".join(["alike", "as ever"])] * 12
    got = {r["doc_id"]: r for r in L.report(docs(rows)).collect()}
    assert [got[i]["text"] for i in range(10)] == [rows[0], *own[1:]]
    assert all(got[i]["n_dropped"] == 0 for i in range(10, 22))


def test_passage_in_two_documents(docs):
    text = lambda i, n: " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i)}" for j in range(n))
    passage, short = text(0, 50), text(1, 49)
    pair = [f"{passage}\n{short}\n{text(i, 60)}" for i in (2, 3)]
    copied = [f"{text(4, 200)}\n{text(5, 50)}\n{x}" for x in ("here", "there")]
    got = {r["doc_id"]: r["text"] for r in L.report(docs(pair + copied)).collect()}
    assert got == {0: pair[0], 1: f"{short}\n{text(3, 60)}", 2: copied[0], 3: copied[1]}


def test_block_with_a_line_of_ones_own(docs):
    block = [" ".join(f"b{chr(97 + i)}{chr(97 + j)}" for j in range(20)) for i in range(12)]
    own = lambda i: " ".join(f"o{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(20))
    for n in (5, 10, 30):
        got = L.report(docs(["\n".join([*block, own(i)]) for i in range(n)])).collect()
        assert sum(r["n_dropped"] for r in got) == 12 * (n - 1), n


def test_one_line_documents(docs):
    rows = ["the same line of a few words stands everywhere"] * 50 + [unique(1)]
    got = {r["doc_id"]: r for r in L.report(docs(rows)).collect()}
    assert sum(r["n_dropped"] for r in got.values()) == 49 and got[0]["text"] == rows[0] and got[50]["text"] == rows[50]


def test_shared_content_stays_once(docs):
    line = lambda w: f"the session of the {w} was closed by the chair of all"
    rows = [f"{unique(0)}\n{line('day')}"] + [f"{unique(i)}\n{line('week')}" for i in range(1, 7)] + [f"{unique(i)}\n{line('x' * i)}" for i in range(7, 12)]
    got = {r["doc_id"]: r["text"] for r in L.report(docs(rows)).collect()}
    assert [line("week") in got[i] for i in range(1, 7)] == [True] + [False] * 5 and line("day") in got[0]
    assert not any("session" in got[i] for i in range(7, 12))  # fields that no other document has go with the template


def test_names_in_a_short_line(docs):
    names = ["Maria Lopez", "Jean Petit", "Ana Souza", "Li Wei", "Tom Reed", "Eva Berg", "Ivo Marsh", "Kim Lund", "Max Hart"]
    got = {r["doc_id"]: r["text"] for r in L.report(docs([f"{unique(i)}\nPosted by {x} in News" for i, x in enumerate(names)])).collect()}
    assert [("Posted" in got[i]) for i in range(9)] == [True] + [False] * 8


def templates(line):
    """The keys of a line, by the rule: kind and a template in plain form."""
    raw = re.findall(r"[^\x20\x09-\x0D]+", line)
    variable = [bool(re.search(L.VARIABLE, t)) for t in raw]
    w = raw if len(raw) < L.LEAD and all(variable) else ["<*>" if v else t for t, v in zip(raw, variable, strict=True)]
    n = len(w)
    edge = lambda j: L.LEAD + (n - L.LEAD) * j // 4
    gaps = [(edge(j), edge(j + 1)) for j in range(4)] if n >= L.WIDE else [(i, i + L.GAP) for i in range(L.GAP, n - L.GAP + 1)] if n >= L.NARROW else []
    keys = [(L.EXACT, n, tuple(w)), (L.HEAD, n, tuple(w[: L.LEAD])), (L.TAIL, n, tuple(w[-L.LEAD :]))]
    return n, sorted(keys + [(L.GENERAL, n, i, tuple(w[:lo]), tuple(w[hi:])) for i, (lo, hi) in enumerate(gaps)]) if n else []


def test_keys_are_the_templates_and_copy_no_arrays(docs):
    plain = [" ".join(f"w{chr(97 + j)}" for j in range(n)) for n in range(1, 27)]
    changed = [" ".join("other" if j == at else t for j, t in enumerate(x.split())) for x in plain for at in range(0, len(x.split()), 2)]
    odd = ["", " ", "\t\r", " lead", "trail ", "a  b", "a\tb", "7", "7 8", "7 8 9", "x 7", "<*> 8 9", "<*> <*> <*>", "see http://a b", "Http://a b c", "漢字 é " * 9, "one\x0btwo\x0cthree 4 five me@x six\r"]
    lines = [*plain, *changed, *odd]
    df = docs(["\n".join(lines)]).select(L.parsed(F.col("text")).alias("p"))
    assert "slice(" not in df._jdf.queryExecution().analyzed().toString()  # each would copy the whole line once more
    got = df.first()["p"]
    named = {}  # the same templates, and these alone, have the same key
    for line, g in zip(lines, got, strict=True):
        n, want = templates(line)
        keys = g["keys"] or []
        assert (g["n"], sorted(k["kind"] for k in keys)) == (n, [k[0] for k in want]), line
        named[line] = {k["key"] for k in keys}
        assert len(named[line]) == len(set(want))
    for a in lines:
        for b in lines:
            assert len(named[a] & named[b]) == len(set(templates(a)[1]) & set(templates(b)[1])), (a, b)

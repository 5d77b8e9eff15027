"""A verdict on one answered question: evidence in the log, figures in the text, and the policy of refusals.

The text check is deliberately narrow. Every row that the answer must give has to stand on a line with
its name and its first measure, read in Brazilian or English notation. In lists and tables it also finds
rows that were not asked for, a second figure for a row that contradicts the first, and numbered places
that are not the row's rank. Units, currencies and free prose beyond that are not judged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tarnspark.functions.text import normalize
from tarnspark.operators.verify import Metric, ResultCheck, Verdict, close, compare, competition_ranks, value_key
from tarnspark.plans.trace import Execution, RunTrace

#: Why a case fails; the first three mean that it was not evaluated.
CATEGORIES = ("provider", "database", "harness", "agent_protocol", "sql_error", "wrong_status", "policy", "ungrounded", "result_mismatch", "answer_text")
NOT_EVALUATED = CATEGORIES[:3]
#: Words by which texts scale numbers.
SCALES = {"mil": 1e3, "thousand": 1e3, "k": 1e3, "mi": 1e6, "milhao": 1e6, "milhoes": 1e6, "million": 1e6, "bi": 1e9, "bilhao": 1e9, "bilhoes": 1e9, "billion": 1e9, "tri": 1e12, "trilhao": 1e12, "trilhoes": 1e12, "trillion": 1e12}
#: Words of a refusal or an offer, in the two languages that answers come in.
NEGATIVE = frozenset("nao nunca jamais not cannot unable never".split())
ABLE = frozenset("posso podemos consigo sei tenho respondo ajudo calculo consulto possivel can able possible answer help know".split())
OUTSIDE = (("fora", frozenset("escopo alcance assunto tema dominio".split())), ("out", frozenset("scope".split())), ("beyond", frozenset("scope".split())))
ONLY, SUBJECT = frozenset("apenas somente so only just".split()), frozenset("filme filmes cinema catalogo movie movies film films catalogue".split())
INVITING = frozenset("pergunte perguntar ask".split())
#: Beginnings of words that name something which can be asked about, one group a topic.
TOPICS = (("film", "movie"), ("catalog",), ("receita", "bilheteria", "revenue"), ("lucr", "marge", "profit", "margin"), ("gener", "genre"), ("nota", "avalia", "rating"), ("ator", "atriz", "elenco", "actor", "cast"), ("diretor", "director"), ("produtora", "studio"), ("ranking",), ("popular",))
#: Words between a negation and what it negates, at most.
REACH = 4


@dataclass(frozen=True)
class CaseVerdict:
    """verdict: pass, fail or error; category: why, or None."""

    verdict: str
    category: str | None = None
    message: str = ""

    @classmethod
    def of(cls, category: str, message: str) -> CaseVerdict:
        return cls("error" if category in NOT_EVALUATED else "fail", category, message)


def _notation(group: str, point: str) -> re.Pattern:
    return re.compile(rf"(?P<whole>\d{{1,3}}(?:{group}\d{{3}})+|\d+)(?:{point}(?P<part>\d+))?")


#: How Brazil and England write numbers.
NOTATIONS = (_notation(r"\.", ","), _notation(",", r"\."))


def readings(body: str) -> set[float]:
    """What a number without sign may mean, one reading a notation: 12.390 is 12390 or 12.39."""
    body = "".join(body.split())
    read = [m for n in NOTATIONS if (m := n.fullmatch(body))]
    return {float(re.sub(r"\D", "", m["whole"]) + "." + (m["part"] or "0")) for m in read}


_NUMBER = re.compile(r"(?<![\w.,])([-−]?)\s?(\d[\d.,]*\d|\d)\s?(%|[a-zA-ZÀ-ÿ]+)?")


def numbers(text: str) -> list[set[float]]:
    """The numbers of a text, each with its possible readings."""
    out = []
    for sign, body, word in _NUMBER.findall(text):
        scale = SCALES.get(normalize(word), 1.0) if word and word != "%" else 1.0
        out.append({(-1 if sign else 1) * r * scale for r in readings(body)})
    return out


_ITEM = re.compile(r"^\s*(?:[-*•]|(?P<place>\d{1,3})\s*[.)ºª°])\s+(?P<rest>.*)$")
_NAMED = re.compile(r"^(?P<name>[^:–—]*\w[^:–—]*?)\s*(?::|\s[–—-]\s)\s*(?P<rest>.*\d.*)$")


def rows_of_text(text: str) -> list[tuple[int | None, str, str]]:
    """(place, name, rest) of list items "1. Name: 12" and of table rows "| Name | 12 |"."""
    out = []
    for line in text.splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if line.strip().startswith("|") and len(cells) > 1:
            place = int(cells[0]) if re.fullmatch(r"\d{1,3}", cells[0]) and len(cells) > 2 else None
            name, rest = (cells[1], cells[2:]) if place is not None else (cells[0], cells[1:])
            if any(re.search(r"\d", c) for c in rest):
                out.append((place, name.replace("*", ""), " | ".join(rest)))
        elif (item := _ITEM.match(line)) and (m := _NAMED.match(item["rest"].replace("**", ""))):
            out.append((int(item["place"]) if item["place"] else None, m["name"], m["rest"]))
    return out


def text_problem(check: ResultCheck, want: list[dict], text: str) -> str | None:
    """None if every row that must be given stands on a line with its measure, and no listed row speaks against it."""
    metric = check.metrics[0]
    ranks = competition_ranks([r[metric.column] for r in want])
    needed = [(r, k) for r, k in zip(want, ranks) if check.shape != "leaders" or k == 1]
    label = check.identity[-1] if check.identity else ()
    named = lambda row: [normalize(str(row[c])) for c in label if row[c] is not None]
    lines = [(normalize(x), numbers(x)) for x in re.split(r"\n+|(?<=[.;!?])\s+(?=\D)", text) if x.strip()]
    for row, _ in needed:
        names = named(row)
        mine = [nums for line, nums in lines if all(n in line for n in names)]
        if not mine:
            return f"no line gives {' / '.join(names)}"
        if not any(_says(row[metric.column], nums, metric) for nums in mine):
            return f"{' / '.join(names) or 'the answer'}: its {metric.column} is not given"
    if not label:
        return None
    for place, name, rest in rows_of_text(text):
        own = [(r, k) for r, k in zip(want, ranks) if normalize(name) and any(n == normalize(name) for n in named(r))]
        if not own and not any(n in normalize(name) for r in want for n in named(r)):
            return f"a row that is not in the result: {name.strip()}"
        if own and not any(_says(r[metric.column], numbers(rest), metric) for r, _ in own):
            return f"{name.strip()}: contradicts its {metric.column}"
        if own and place is not None and check.shape == "ranked" and place not in {k for _, k in own} and place not in _places(want, ranks, own):
            return f"{name.strip()}: stands at place {place}"
    return None


def _places(want: list[dict], ranks: list[int], own: list[tuple[dict, int]]) -> set[int]:
    """Places at which tied rows may be numbered one after the other."""
    return {k + i for _, k in own for i in range(sum(r == k for r in ranks))}


def _says(value: object, nums: list[set[float]], metric: Metric) -> bool:
    if value is None:
        return True
    shown = [r for n in nums for r in n]
    # a text may round: one unit of the sixth significant digit, or the metric's own tolerance
    return any(close(r, value, metric, s) or abs(r - float(value) * s) <= abs(float(value) * s) * 5e-6 for r in shown for s in metric.scales)


def evidence(check: ResultCheck, want: list[dict], e: Execution, read_before_answer: bool = True) -> Verdict:
    """A statement bears an answer out if its result matches, was read before the answer, and was shown whole."""
    v = compare(check, want, e.result.columns, e.result.rows, e.result.truncated)
    if v.ok and not read_before_answer:
        return Verdict("not_read_before_answer", "it was asked for together with the answer", v.matched_rows, v.columns)
    if v.ok and e.rows_shown < len(e.result.rows):
        keys = {tuple(value_key(x) for x in r) for r in e.result.rows[: e.rows_shown]}
        if len(keys) < len(want):
            return Verdict("rows_not_shown", f"{e.rows_shown} of {len(e.result.rows)} rows were shown", v.matched_rows, v.columns)
    return v


def policy_problem(policy: str, text: str) -> str | None:
    """``refusal``: says that it will not; ``capabilities``: says what it can do, on two topics at least."""
    words = normalize(text).split()
    near = lambda i: words[max(0, i - REACH) : i]
    if policy == "refusal":
        denied = any(w in ABLE and NEGATIVE & {*near(i)} for i, w in enumerate(words)) or "cannot" in words
        outside = any(w in ends and begin in near(i) for begin, ends in OUTSIDE for i, w in enumerate(words))
        limited = any(w in SUBJECT and ONLY & {*near(i)} for i, w in enumerate(words))
        return None if denied or outside or limited else "the text refuses nothing"
    if policy == "capabilities":
        offers = any(w in INVITING or w in ABLE and not NEGATIVE & {*words[max(0, i - 2) : i]} for i, w in enumerate(words))
        topics = sum(any(w.startswith(t) for w in words for t in group) for group in TOPICS)
        return None if offers and topics >= 2 else "the text does not say what can be asked"
    raise ValueError(f"unknown policy {policy!r}")


def judge(check: ResultCheck, want: list[dict], trace: RunTrace, text: str | None, unread: frozenset[int] = frozenset()) -> CaseVerdict:
    """Verdict on a data answer. ``unread``: statements asked for together with the answer."""
    if text is None:
        return CaseVerdict.of("agent_protocol", "there is no answer")
    done = trace.successful()
    if not done:
        return CaseVerdict.of("sql_error" if trace.executions else "ungrounded", "no statement succeeded")
    found = [evidence(check, want, e, e.index not in unread) for e in done]
    if not any(v.ok for v in found):
        best = max(found, key=lambda v: v.matched_rows)
        return CaseVerdict.of("result_mismatch", f"{best.problem}: {best.message}")
    if problem := text_problem(check, want, text):
        return CaseVerdict.of("answer_text", problem)
    return CaseVerdict("pass")

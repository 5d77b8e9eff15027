"""Numbers in text, figures by row, policy texts, verdicts and the result store."""

import pytest

from tarnspark.operators.cases import CASES, variant
from tarnspark.operators.verdict import CaseVerdict, judge, numbers, policy_problem, readings, text_problem
from tarnspark.operators.verify import CHECKS
from tarnspark.plans.executor import QueryResult
from tarnspark.plans.store import ResultStore
from tarnspark.plans.trace import Execution, RunTrace

WANT = [{"genero": "Drama", "filmes": 1234}, {"genero": "Ação", "filmes": 7}]


@pytest.mark.parametrize("body,want", [("12.390", {12390.0, 12.39}), ("1.234,5", {1234.5}), ("1,234.5", {1234.5}), ("65", {65.0}), ("1.234.567", {1234567.0}), ("0,25", {0.25})])
def test_readings(body, want):
    assert readings(body) == want


def test_numbers():
    assert numbers("R$ 2,5 bilhões e -3 e 12%") == [{2.5e9}, {-3.0}, {12.0}]


def test_text():
    check = CHECKS["q10"]
    assert text_problem(check, WANT, "- Drama: 1.234 filmes\n- Ação: 7 filmes") is None
    assert "acao" in text_problem(check, WANT, "- Drama: 1.234 filmes")
    assert "not given" in text_problem(check, WANT, "- Drama: 1.235\n- Ação: 7")


def test_listed_rows():
    check = CHECKS["q10"]
    good = "- Drama: 1.234 filmes\n- Ação: 7 filmes"
    assert "not in the result" in text_problem(check, WANT, good + "\n- Terror: 5 filmes")
    assert "contradicts" in text_problem(check, WANT, good + "\n- Drama: 999 filmes")
    assert text_problem(check, WANT, "| Gênero | Filmes |\n|---|---|\n| Drama | 1.234 |\n| Ação | 7 |") is None
    assert "not in the result" in text_problem(check, WANT, "| Drama | 1.234 |\n| Ação | 7 |\n| Terror | 5 |")
    ranking = next(c for c in CHECKS.values() if c.shape == "ranked" and len(c.identity) and len(c.identity[-1]) == 1)
    name, value = ranking.identity[-1][0], ranking.metrics[0].column
    want = [{name: "Alpha", value: 30}, {name: "Beta", value: 20}, {name: "Gamma", value: 20}]
    want = [{c: None for i in ranking.identity for c in i} | r for r in want]
    assert text_problem(ranking, want, "1. Alpha: 30\n2. Gamma: 20\n3. Beta: 20") is None
    assert "place 1" in text_problem(ranking, want, "2. Alpha: 30\n1. Beta: 20\n3. Gamma: 20") or "place 2" in text_problem(ranking, want, "2. Alpha: 30\n1. Beta: 20\n3. Gamma: 20")


def test_policy():
    assert policy_problem("refusal", "I cannot help with that.") is None and policy_problem("refusal", "Isso está fora do meu escopo.") is None and policy_problem("refusal", "Respondo apenas sobre filmes.") is None
    assert policy_problem("capabilities", "Não posso falar de filmes e notas.") and policy_problem("capabilities", "You can ask about movies and ratings.") is None
    assert policy_problem("refusal", "Não posso ajudar com isso.") is None and policy_problem("refusal", "Claro!")
    assert policy_problem("capabilities", "Posso responder sobre filmes e notas.") is None and policy_problem("capabilities", "Olá!")


def test_judge():
    rows = (("drama", 1234), ("Ação", 7))
    trace = RunTrace(50, [Execution(1, "SELECT 1", QueryResult(("g", "n"), rows, False, 50, 0.0), None, 2)])
    text = "Drama 1234\nAção 7"
    assert judge(CHECKS["q10"], WANT, trace, text).verdict == "pass"
    assert judge(CHECKS["q10"], WANT, trace, "Drama 1").category == "answer_text"
    assert judge(CHECKS["q10"], WANT, trace, text, frozenset({1})).category == "result_mismatch"
    assert judge(CHECKS["q10"], WANT[:1], trace, text).category == "result_mismatch"
    assert judge(CHECKS["q10"], WANT, RunTrace(50), text).category == "ungrounded"
    assert judge(CHECKS["q10"], WANT, RunTrace(50, [Execution(1, "x", None, "bad")]), text).category == "sql_error"
    assert judge(CHECKS["q10"], WANT, trace, None).category == "agent_protocol" and CaseVerdict.of("database", "").verdict == "error"
    trace.executions[0].rows_shown = 1
    assert judge(CHECKS["q10"], WANT, trace, text).category == "result_mismatch"


def test_store(tmp_path):
    s = ResultStore(tmp_path / "r.json", {"rows": 50})
    s.put(CASES["q01"], CaseVerdict("pass"))
    s.put(CASES["q02"], CaseVerdict.of("provider", "down"))
    again = ResultStore(tmp_path / "r.json", {"rows": 50}, resume=True)
    assert again.is_final(CASES["q01"]) and not again.is_final(CASES["q02"]) and not again.is_final(variant("q01", limit=3)) and not again.is_final(CASES["q03"])
    assert "| q02 | error | provider | down |" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        ResultStore(tmp_path / "r.json", {"rows": 51}, resume=True)

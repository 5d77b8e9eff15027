"""Linking against a plain-Python rendering: joins, order, validation, canonical JSON."""

import json

from tarnspark.llm import tool_calls as T

SCHEMAS = {"search": {"q": ("STRING", True), "n": ("BIGINT", False)}, "stop": {}}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, parent_id string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def link(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS)
    return {(r["conv_id"], r["call_id"]): r for r in T.link(c, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}


def test_links(spark):
    calls = [
        (1, "a", 0, "search", '{"q": "x\\n\\u00e9", "n": 3}', None), (1, "b", 1, "search", '{"n": "3", "z": 1}', "a"), (1, "c", 2, "stop", "{}", "b"), (1, "d", 3, "nope", "{}", "zz"), (1, "e", 4, "search", "[1]", "f"), (1, "f", 5, "search", '{"q": 1', "e"),
        (1, "g", 6, "stop", None, "e"), (2, "a", 0, "search", '{"q":"y"}', "c"), (2, "a", 9, "stop", "{}", None), (None, "a", 0, "stop", "{}", None), (3, None, 0, "stop", "{}", None),
    ]
    results = [(1, "a", 1, "ok"), (1, "c", 3, None), (1, "q", 3, "lost"), (2, "a", 4, "second"), (2, "a", 3, "first"), (None, "a", 1, "x")]
    got = link(spark, calls, results)
    see = lambda k: (got[k]["status"], got[k]["errors"], got[k]["depth"])
    assert see((1, "a")) == ("linked", "", 0) and got[1, "a"]["canonical"] == '{"n":3,"q":"x\\né"}'
    assert json.loads(got[1, "a"]["message"]) == {"arguments": {"n": 3, "q": "x\né"}, "id": "a", "name": "search", "result": "ok"}
    assert see((1, "b")) == ("invalid", "n:not bigint;q:missing;z:unknown", 1)
    assert see((1, "c")) == ("linked", "", 2) and json.loads(got[1, "c"]["message"])["result"] is None
    assert see((1, "d")) == ("invalid", "tool:unknown;parent:missing", 0)
    assert see((1, "e")) == ("bad_json", "arguments:not object;parent:cycle", None) and see((1, "g"))[2] is None
    assert got[1, "f"]["canonical"] is None
    assert got[1, "q"]["status"] == "orphan" and got[1, "q"]["n_calls"] == 0
    assert (got[2, "a"]["n_calls"], got[2, "a"]["n_results"], got[2, "a"]["name"], got[2, "a"]["result"]) == (2, 2, "search", "first")
    assert (got[None, "a"]["status"], got[3, None]["status"], got[3, None]["errors"]) == ("orphan", "invalid", "id:missing")
    assert len(got) == 11


def test_long_chain_and_unanswered(spark):
    n = 300
    calls = [(7, f"c{i}", i, "stop", "{}", f"c{i - 1}" if i else None) for i in range(n)]
    got = link(spark, calls[::-1], [])
    assert all(got[7, f"c{i}"]["depth"] == i and got[7, f"c{i}"]["status"] == "unanswered" for i in range(n))
    assert link(spark, [], []) == {}


def test_order_of_a_conversation(spark):
    calls = [(1, "r", 5, "stop", "{}", None), (1, "a", 1, "stop", "{}", "r"), (1, "b", 0, "stop", "{}", "a"), (1, "s", 5, "stop", "{}", None), (1, "x", 2, "stop", "{}", "y"), (1, "y", 2, "stop", "{}", "x"), (2, "z", 0, "stop", "{}", None)]
    got = link(spark, calls, [])
    assert {k: got[1, k]["position"] for k in "rsabxy"} == {"r": 1, "s": 2, "a": 3, "b": 4, "x": None, "y": None} and got[2, "z"]["position"] == 1


def test_one_form_of_numbers(spark):
    forms = ["1e2", "100", "100.0", "1.0E+2", "0.10", "1e-1", "-0", "-0.0", "0.5e-9", "12345678901234567890", "1e400"]
    calls = [(i, "a", 0, "search", f'{{"q": "1e2 \\\\ \\"5.0\\"", "n": {x}}}', None) for i, x in enumerate(forms)]
    got = link(spark, calls, [])
    n = [got[i, "a"]["canonical"].split(",")[0].removeprefix('{"n":') if got[i, "a"]["canonical"] else None for i in range(len(forms))]
    assert n[:9] == ["100"] * 4 + ["0.1"] * 2 + ["0"] * 2 + ["5.0E-10"] and n[9] == "12345678901234567890"
    assert [got[i, "a"]["errors"] for i in range(9)] == [""] * 4 + ["n:not bigint"] * 2 + [""] * 2 + ["n:not bigint"]
    assert json.loads(got[0, "a"]["canonical"])["q"] == '1e2 \\ "5.0"'


def test_result_before_its_call_ties_and_long_texts(spark):
    long = "x" * 300_000
    calls = [(1, "a", 6, "search", json.dumps({"q": long}), None), (1, "b", 2, "stop", "{}", None), (1, "b", 2, "stop", "[]", None), (1, "c", 3, "stop", "{}", None)]
    results = [(1, "a", 1, "early"), (1, "b", 3, "two"), (1, "b", 3, "one"), (1, "c", 3, "same")]
    got = link(spark, calls, results)
    assert (got[1, "a"]["status"], got[1, "a"]["errors"]) == ("invalid", "result:before call") and got[1, "a"]["canonical"] == json.dumps({"q": long}, separators=(",", ":"))
    assert (got[1, "b"]["status"], got[1, "b"]["result"], got[1, "b"]["n_calls"], got[1, "b"]["n_results"]) == ("bad_json", "one", 2, 2)
    assert got[1, "c"]["errors"] == "result:before call"


def test_joins_are_hash_joins(spark):
    c, r = spark.createDataFrame([(1, "a", 0, "stop", "{}", None)], CALLS.rsplit(",", 1)[0]), spark.createDataFrame([(1, "a", 1, "x")], RESULTS)
    plan = T.link(c, r, SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_calls_in_the_text(spark):
    say = '{"id": "k", "name": "search", "arguments": {"q": "x"}, "parent": null}'
    turns = spark.createDataFrame([(1, 0, "assistant", say), (1, 1, "user", "{broken!"), (1, 2, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    got = {r["call_id"]: r for r in T.link(*T.from_conversations(turns), SCHEMAS | T.TURN_SCHEMAS).collect()}
    assert got["k"]["canonical"] == '{"q":"x"}' and got["turn_1"]["status"] == "linked" and len(got) == 2


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be nice!"), (1, 1, "user", 'say "hi"'), (1, 2, "assistant", "hi"), (1, 3, "user", None), (2, 0, "assistant", "odd"), (3, 0, None, "x")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["call_id"]): r for r in T.link(*T.from_conversations(turns), T.TURN_SCHEMAS).collect()}
    assert got[1, "turn_0"]["errors"] == "scope:missing" and got[1, "turn_1"]["status"] == "linked" and got[1, "turn_3"]["errors"] == "text:missing"
    assert got[2, "turn_-1"]["status"] == "orphan" and got[3, "turn_0"]["errors"] == "tool:unknown"

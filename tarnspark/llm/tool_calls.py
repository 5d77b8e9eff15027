"""Op 3 [native]: tool-call linking.

Calls and results are joined by shuffled hash on (conversation, call id); both sides have one row a key by
then. Calls form forests through the result they consume (``parent_id``); depths come from pointer
doubling, so a chain of n calls takes about log2(n) joins, and (depth, turn, call id) is a topological
order; ``position`` is a call's place in its conversation's order, counted over sorted ranges so that a
conversation may be of any length. Arguments are parsed as VARIANT, checked against the tool's schema, and
written as canonical JSON: keys sorted, no white space, numbers in one form (1e2, 100.0 and 100 are 100).
Types are checked in that form; where a schema asks for DOUBLE, any number will do.

Defined cases: arguments that are no JSON object give status bad_json and null canonical text; unknown
tools, missing, mistyped and unknown arguments are listed in ``errors``; a call without a result is
``unanswered``, a result without a call ``orphan``; repeated calls or results of one id count in
n_calls and n_results and the first by turn (then text) stands for them; a result that stands before its
call, or in its turn, is error ``result:before call``; a parent that does not exist makes the call a root
with error ``parent:missing``; calls on a cycle, and those that hang on one, have depth and position null
and error ``parent:cycle``; calls and results with a null id never match anything and come out one by one,
calls with error ``id:missing`` and null depth, results as orphans; numbers beyond 2 ** 53 or with more
digits than a double holds keep their integer digits or become the nearest double; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import Scratch, let, placed, split_join

#: name -> {argument: (VARIANT type, required)}
Schemas = dict[str, dict[str, tuple[str, bool]]]

KEY = ["conv_id", "call_id"]


#: A JSON string, or a number.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+'


def plain_numbers(json: Column) -> Column:
    """JSON text with every number in one form: whole ones as integers, others as the shortest double."""

    def number(m: Column) -> Column:
        d = m.try_cast("double")
        whole = F.when((F.abs(d) < 2**53) & (d == F.floor(d)), d.cast("long").cast("string")).when(F.abs(d) < float("inf"), d.cast("string"))
        return F.when(m.startswith('"'), m).when(m.rlike("^-?[0-9]{16,}$"), m).otherwise(F.coalesce(whole, m))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["gap"], lambda g, i: F.concat(g, F.coalesce(number(F.get(x["m"], i)), F.lit("")))), "")

    return F.when(json.rlike("[0-9]"), let(F.struct(F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0)).alias("m"), F.split(json, TOKEN, -1).alias("gap")), joined)).otherwise(json)


def hashed(df: DataFrame) -> DataFrame:
    """The side of a join that the hash table is built of."""
    return df.hint("shuffle_hash")


def first_of(rows: DataFrame, value: str, count: str) -> DataFrame:
    """One row a (conversation, id): its first row by turn and text, and how many there were. Rows with a null id stay single."""
    cols = [c for c in rows.columns if c not in (*KEY, "turn", value)]
    whole = F.struct("turn", value, *cols)
    known = " and ".join(f"{k} is not null" for k in KEY)
    named = rows.where(known).groupBy(*KEY).agg(F.min(whole).alias("x"), F.count(F.lit(1)).alias(count))
    nameless = rows.where(f"not ({known})").select(*KEY, whole.alias("x"), F.lit(1).cast("long").alias(count))
    return named.unionByName(nameless).select(*KEY, "x.*", count)


def argument_errors(name: Column, v: Column, schemas: Schemas) -> Column:
    """array<string> of what is wrong with an arguments object, in order of the argument's name."""
    kind = lambda f: F.regexp_replace(F.schema_of_variant(F.try_variant_get(v, f"$['{f}']", "variant")), "[<(].*", "")
    known = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        checks = []
        for f, (want, required) in sorted(fields.items()):
            absent = F.lit(f"{f}:missing") if required else F.lit(None).cast("string")
            fits = kind(f).isin("BIGINT", "DECIMAL", "DOUBLE") if want == "DOUBLE" else kind(f) == want
            checks.append(F.when(kind(f).isNull(), absent).when(~fits, F.lit(f"{f}:not {want.lower()}")))
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, fields)))), lambda k: F.concat(k, F.lit(":unknown")))
        found = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), F.coalesce(extra, F.array().cast("array<string>")))
        known = F.when(name == tool, found).otherwise(known)
    return F.coalesce(known, F.array(F.lit("tool:unknown")))


def depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, depth, parent_error: pointer doubling over (conversation, id) -> parent."""
    own = calls.where(" and ".join(f"{k} is not null" for k in KEY)).select("conv_id", "call_id", "parent_id")
    parents = own.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"))
    state = own.join(hashed(parents), (own.conv_id == F.col("c")) & (own.parent_id == F.col("p")), "left")
    state = state.select("conv_id", "call_id", F.col("p").alias("to"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("steps"), (F.col("parent_id").isNotNull() & F.col("p").isNull()).alias("lost"))
    state = scratch.keep(state)
    total, open_ = state.agg(F.count(F.lit(1)), F.count("to")).first()
    for _ in range(math.ceil(math.log2(total + 2)) if open_ else 0):
        far = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), F.col("to").alias("next"), F.col("steps").alias("more"))
        new = state.join(hashed(far), (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("p")), "left")
        new = scratch.keep(new.select("conv_id", "call_id", F.col("next").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "lost"))
        scratch.drop(state)
        state, open_ = new, new.where(F.col("to").isNotNull()).limit(1).count()
        if not open_:
            break
    error = F.when(F.col("lost"), "parent:missing").when(F.col("to").isNotNull(), "parent:cycle")
    return state.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("steps")).alias("depth"), error.alias("parent_error"))


def positions(found: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, call_id, position: places in a conversation's order of (depth, turn, call id), from 1.

    Calls are range-partitioned by conversation and order, so a long conversation is several ranges; a
    place is the row's place in its range plus the rows of the ranges before, less the conversation's first.
    """
    order = ["conv_id", "depth", F.col("turn").asc_nulls_first(), "call_id"]
    at = scratch.keep(placed(found, order, scratch, "place").select("conv_id", "call_id", "place"))
    start = scratch.keep(at.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("c")))
    return split_join(at, start, "conv_id", "c").select("conv_id", "call_id", (F.col("place") - F.col("start") + 1).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Linked calls: conv_id, call_id, depth, position, turn, name, status, errors, canonical, result_turn, result, n_calls, n_results, message.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), parent_id; ``results``: conv_id,
    call_id, turn, content. ``message`` is the whole linked call as canonical JSON.
    """
    scratch = Scratch(calls.sparkSession)
    c = scratch.keep(first_of(calls.select(*KEY, "turn", "arguments", "name", "parent_id"), "arguments", "n_calls"))
    r = first_of(results.select(*KEY, "turn", "content"), "content", "n_results")
    r = r.select(*KEY, F.col("turn").alias("result_turn"), F.col("content").alias("result"), "n_results")
    deep = scratch.keep(c.select(*KEY, "turn").join(hashed(depths(c, scratch)), KEY))
    place = positions(deep.where("depth is not null").select(*KEY, "depth", "turn"), scratch)
    joined = c.join(hashed(deep.drop("turn")), KEY, "left").join(hashed(place), KEY, "left").join(hashed(r), KEY, "full")
    parsed = joined.withColumn("v", F.try_parse_json(plain_numbers(F.col("arguments"))))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("called", F.col("n_calls").isNotNull()).withColumn("object", is_object)
    parsed = parsed.withColumn("canonical", F.when(F.col("object"), F.to_json("v")))
    wrong = F.when(~F.col("called"), F.array().cast("array<string>")).when(~F.col("object"), F.array(F.lit("arguments:not object"))).otherwise(argument_errors(F.col("name"), F.col("v"), schemas))
    early = F.when(F.col("called") & (F.col("result_turn") <= F.col("turn")), "result:before call")
    nameless = F.when(F.col("called") & (F.col("conv_id").isNull() | F.col("call_id").isNull()), "id:missing")
    errors = F.concat(wrong, F.filter(F.array("parent_error", early, nameless), lambda x: x.isNotNull()))
    status = F.when(~F.col("called"), "orphan").when(~F.col("object"), "bad_json").when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    out = parsed.withColumn("errors", errors).withColumn("status", status)
    whole = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substring(whole(c), F.lit(6), F.length(whole(c)) - 6))
    message = F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), text("result"), F.lit("}"))
    return out.select("conv_id", "call_id", "depth", "position", "turn", "name", "status", F.array_join("errors", ";").alias("errors"), "canonical", "result_turn", "result", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), message.alias("message"))


#: Tools as which the turns of a conversation are read.
TURN_SCHEMAS: Schemas = {
    "user": {"text": ("STRING", True), "turn": ("BIGINT", True)},
    "system": {"text": ("STRING", True), "turn": ("BIGINT", True), "scope": ("STRING", True)},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as which a conversation reads.

    A turn whose text is a JSON object with ``name`` and ``arguments`` is a call as it says (``id`` and
    ``parent`` too, where given). Other turns of users and systems call with their text as argument; the
    assistant's turn answers the turn before it, and a call's parent is the call two turns before, whose
    answer it follows. By a rule on the text's length n some of these arguments are damaged, so that every
    kind of finding occurs: n mod 13 = 5 is cut short, 7 has the turn as a text, 9 an unknown argument, and
    11 writes the turn with a fraction of zero. A system's call lacks the argument ``scope`` of its schema.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.from_json(F.when(F.col("text").rlike(r"^\s*\{"), F.col("text")), "id string, name string, arguments string, parent string")
    t = t.withColumn("said", said).withColumn("is_call", F.coalesce(F.col("said.name").isNotNull() & F.col("said.arguments").isNotNull(), F.lit(False)))
    name = lambda n: F.concat(F.lit("turn_"), n.cast("string"))
    n = F.pmod(F.coalesce(F.length("text"), F.lit(0)), F.lit(13))
    turn = F.when(n == 7, F.concat(F.lit('"'), F.col("turn"), F.lit('"'))).when(n == 11, F.concat(F.col("turn").cast("string"), F.lit(".0"))).otherwise(F.col("turn").cast("string"))
    body = F.concat(F.lit('{"turn": '), F.coalesce(turn, F.lit("null")), F.regexp_replace(F.to_json(F.struct("text")), r"^\{(?=.)", ", "))
    body = F.when(F.col("text").isNull(), F.concat(F.lit('{"turn": '), F.coalesce(turn, F.lit("null")), F.lit("}"))).otherwise(body)
    body = F.when(n == 5, F.substring(body, F.lit(1), F.length(body) - 1)).when(n == 9, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(', "more": [1e2, 2.50]}'))).otherwise(body)
    pick = lambda own, rule: F.when(F.col("is_call"), own).otherwise(rule)
    calls = t.where("is_call or role <> 'assistant' or role is null").select(
        "conv_id", pick(F.coalesce("said.id", name(F.col("turn"))), name(F.col("turn"))).alias("call_id"), "turn", pick(F.col("said.name"), F.col("role")).alias("name"),
        pick(F.col("said.arguments"), body).alias("arguments"), pick(F.col("said.parent"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2))).alias("parent_id"),
    )
    results = t.where("role = 'assistant' and not is_call").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results

"""Chat formatting: tool calls and their results linked, ordered, validated and serialised, with DataFrame functions alone.

Calls are aggregated by (conversation, identifier), so a result meets one call at most and repeated rows cannot multiply.
A result depends on its call, and a call on the results of the calls that it uses. Messages, calls and results get a sort key (order_turn,
order_depth, turn) that is a topological order: a result stands no earlier than its call, a call no earlier than the first results that it uses,
and what waits for something of its own turn stands deeper there, one step a dependency. The keys are found by joins by identifier, in rounds as
many as calls that wait for one another in one turn stand in a chain; where all that is used comes from earlier turns, one round is
enough. So no conversation is gathered in one task however long it is. Arguments are parsed as variants and checked against the tools' fields.
Canonical JSON has sorted keys, no white space and no null fields.

A null text, conversation or turn stays null and its field is left out; a null identifier links nothing. Each call is a row: those of one
identifier are all reported as repeated, and the first of them in (turn, tool, arguments) order stands for all where results link and
calls use it; equal rows are kept, and ties stay ties. Results without a call are reported as unlinked, uses of no call as unknown, and calls that
use one another in a circle as circular; they stand in their turn. Texts of any length are one row's work. Empty tables give no rows. Columns of
other names are not read.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise


class Field(NamedTuple):
    tool: str
    name: str
    kind: str  # string, integer, number, boolean, array or object
    required: bool = True


# What a variant's schema starts with for each JSON type.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def problems(tool: Column, arguments: Column, parsed: Column, fields: list[Field]) -> Column:
    """What is wrong with a call, as an array of strings; empty for a valid one."""
    found = [F.when(~F.coalesce(tool.isin(sorted({f.tool for f in fields})), F.lit(False)), F.lit("unknown tool"))]
    found.append(F.when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.lit("arguments are not an object")))
    for f in fields:
        value = F.try_variant_get(parsed, f"$.{f.name}", "variant")
        kind = F.schema_of_variant(value)
        absent = F.coalesce(kind == "VOID", F.lit(True))
        wrong = F.when(absent, F.lit(f"{f.name} is missing") if f.required else F.lit(None)).when(~kind.rlike(f"^({KINDS[f.kind]})"), F.lit(f"{f.name} is not {f.kind}"))
        found.append(F.when(tool == f.tool, wrong))
    return F.array_compact(F.array(*found))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def call_order(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_depth, circular) of calls (conv_id, call_id, turn, first_result), one row per identifier.

    first_result: the turn of the call's first result, or null. uses: (conv_id, call_id, used), used being calls' identifiers too."""
    placed = materialise(calls.select("conv_id", "call_id", "first_result", F.col("turn").alias("at"), F.lit(False).alias("moved")), "placed")
    if uses.limit(1).count() == 0:
        return placed.select("conv_id", "call_id", F.col("at").alias("order_turn"), F.lit(1).alias("order_depth"), F.lit(False).alias("circular"))
    # the turn in which a call's first result stands
    ready = lambda rows: rows.select(F.col("conv_id").alias("u_conv"), F.col("call_id").alias("used"), F.col("at").alias("used_at"), F.greatest("at", "first_result").alias("ready"))
    while True:
        waits = uses.join(ready(placed).withColumnRenamed("used", "u_id"), _same("conv_id", "u_conv") & (F.col("used") == F.col("u_id"))).groupBy("conv_id", "call_id").agg(F.max("ready").alias("ready"))
        waits = waits.select(F.col("conv_id").alias("w_conv"), F.col("call_id").alias("w_id"), "ready")
        later = placed.join(waits, _same("conv_id", "w_conv") & (F.col("call_id") == F.col("w_id")), "left").withColumn("to", F.greatest("at", "ready"))
        placed = materialise(later.select("conv_id", "call_id", "first_result", F.col("to").alias("at"), (~F.col("to").eqNullSafe(F.col("at"))).alias("moved")), "placed")
        if placed.filter("moved").limit(1).count() == 0:
            break
    own = placed.select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_id"), "at")
    met = uses.join(ready(placed).withColumnRenamed("used", "u_id"), _same("conv_id", "u_conv") & (F.col("used") == F.col("u_id"))).join(own, _same("conv_id", "o_conv") & (F.col("call_id") == F.col("o_id")))
    tied = materialise(met.filter("ready = at").select("conv_id", "call_id", "used", F.col("used_at").eqNullSafe(F.col("at")).alias("waits")), "tied")
    after_result = tied.filter("not waits").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id")).distinct()
    waiting = tied.filter("waits").select("conv_id", "call_id", "used")
    some = waiting.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id")).distinct()
    match = _same("conv_id", "r_conv") & (F.col("call_id") == F.col("r_id"))
    least = placed.select("conv_id", "call_id").join(after_result, match, "left").select("conv_id", "call_id", F.when(F.col("r_id").isNotNull(), 3).otherwise(1).alias("least"))
    least = materialise(least, "least")
    done = materialise(least.join(some, match, "left_anti").select("conv_id", "call_id", F.col("least").alias("depth")), "depths")
    rounds = [done]
    while waiting.limit(1).count():
        known = done.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"), "depth")
        found = waiting.join(known, _same("conv_id", "k_conv") & (F.col("used") == F.col("k_id")), "left").groupBy("conv_id", "call_id").agg(F.max(F.col("depth") + 2).alias("after"), F.count_if(F.col("depth").isNull()).alias("open"))
        free = found.filter("open = 0").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), "after")
        new = materialise(least.join(free, match).select("conv_id", "call_id", F.greatest("least", "after").alias("depth")), "depths")
        if new.limit(1).count() == 0:
            break
        waiting = materialise(waiting.join(free.drop("after"), match, "left_anti"), "waiting")
        rounds.append(new)
        done = materialise(functools.reduce(DataFrame.union, rounds), "depths")
    depths = functools.reduce(DataFrame.union, rounds).withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_id"})
    return placed.join(depths, match, "left").select("conv_id", "call_id", F.col("at").alias("order_turn"), F.coalesce("depth", F.lit(1)).alias("order_depth"), F.col("depth").isNull().alias("circular"))


def format_chats(messages: DataFrame, calls: DataFrame, fields: list[Field]) -> DataFrame:
    """messages: conv_id, turn, role, text, result_of (the identifier of the call that it answers, or null).
    calls: conv_id, turn, call_id, tool, arguments (JSON text), and uses, where there is one (the identifiers of calls whose results it uses).

    Per message and per call one row: conv_id, turn, kind (message, call or result), call_id, linked, valid, problems,
    order_turn, order_depth, json."""
    no_uses = F.array().cast("array<string>")
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", (F.coalesce("uses", no_uses) if "uses" in calls.columns else no_uses).alias("uses"))
    named = calls.filter(F.col("call_id").isNotNull())
    results = messages.filter(F.col("result_of").isNotNull()).select("conv_id", "turn", "role", "text", F.col("result_of").alias("call_id"))
    answered = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first_result")).withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_id"})
    one = named.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "tool", "arguments", "uses")).alias("c"), F.count("*").alias("n_calls"))
    one = one.join(answered, _same("conv_id", "r_conv") & (F.col("call_id") == F.col("r_id")), "left")
    one = materialise(one.select("conv_id", "call_id", "c.turn", "c.tool", "c.uses", "n_calls", F.col("r_id").isNotNull().alias("answered"), "first_result"), "calls")
    wanted = one.select("conv_id", "call_id", F.explode(F.array_distinct("uses")).alias("used")).filter(F.col("used").isNotNull())
    ids = one.select(F.col("conv_id").alias("i_conv"), F.col("call_id").alias("i_id"))
    known = wanted.join(ids, _same("conv_id", "i_conv") & (F.col("used") == F.col("i_id")), "left")
    known = materialise(known.select("conv_id", "call_id", "used", F.col("i_id").isNotNull().alias("known")), "uses")
    ordered = call_order(one, known.filter("known").drop("known"))
    unknown = known.filter("not known").select(F.col("conv_id").alias("u_conv"), F.col("call_id").alias("u_id")).distinct()
    facts = one.join(ordered.withColumnsRenamed({"conv_id": "o_conv", "call_id": "o_id"}), _same("conv_id", "o_conv") & (F.col("call_id") == F.col("o_id")))
    facts = facts.join(unknown, _same("conv_id", "u_conv") & (F.col("call_id") == F.col("u_id")), "left")
    facts = facts.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), F.col("tool").alias("c_tool"), "n_calls", "answered", F.col("order_turn").alias("c_turn"), F.col("order_depth").alias("c_depth"), "circular", F.col("u_id").isNotNull().alias("unknown"))
    facts = materialise(facts, "call-facts")
    of_call = _same("conv_id", "c_conv") & (F.col("call_id") == F.col("c_id"))

    linked = results.hint("shuffle_hash").join(facts, of_call, "left")
    result_rows = linked.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("c_id").isNotNull().alias("linked"), F.col("c_id").isNotNull().alias("valid"),
        F.when(F.col("c_id").isNull(), F.array(F.lit("no such call"))).otherwise(no_uses).alias("problems"),
        F.greatest("turn", "c_turn").alias("order_turn"), F.when(F.greatest("turn", "c_turn") == F.col("c_turn"), F.col("c_depth") + 1).otherwise(2).alias("order_depth"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("c_tool").alias("name"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"),
    )
    parsed = named.withColumn("v", F.try_parse_json("arguments")).join(facts, of_call)
    said = lambda when, what: F.when(when, F.lit(what))
    more = F.array_compact(F.array(said(F.col("n_calls") > 1, "repeated identifier"), said(F.col("unknown"), "uses an unknown call"), said(F.col("circular"), "circular use")))
    checked = parsed.withColumn("problems", F.concat(problems(F.col("tool"), F.col("arguments"), F.col("v"), fields), more))
    call_rows = checked.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("answered").alias("linked"), (F.size("problems") == 0).alias("valid"), "problems",
        F.greatest("turn", "c_turn").alias("order_turn"), F.when(F.coalesce(F.col("turn") > F.col("c_turn"), F.lit(False)), 1).otherwise(F.col("c_depth")).alias("order_depth"),
        F.to_json(F.struct(F.col("v").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), F.lit("tool_call").alias("role"))).alias("json"),
    )
    unnamed = calls.filter(F.col("call_id").isNull()).withColumn("v", F.try_parse_json("arguments"))
    unnamed_rows = unnamed.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.lit(False).alias("linked"), F.lit(False).alias("valid"), F.concat(F.array(F.lit("no identifier")), problems(F.col("tool"), F.col("arguments"), F.col("v"), fields)).alias("problems"),
        F.col("turn").alias("order_turn"), F.lit(1).alias("order_depth"), F.to_json(F.struct(F.col("v").alias("arguments"), F.col("tool").alias("name"), F.lit("tool_call").alias("role"))).alias("json"),
    )
    plain = messages.filter(F.col("result_of").isNull())
    plain_rows = plain.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit(True).alias("valid"), no_uses.alias("problems"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return plain_rows.unionByName(call_rows).unionByName(unnamed_rows).unionByName(result_rows)


#: The tool that the table's user turns call.
REPLY = [Field("reply", "prompt", "string"), Field("reply", "words", "integer"), Field("reply", "language", "string", False)]


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and calls of a table of turns: a user's turn calls the tool `reply`, the assistant's next turn is its result, and a user's turn
    after a reply uses that. Rows without a conversation or a turn have no identifier."""
    at = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    messages = conversations.select("conv_id", "turn", "role", "text", F.when((F.col("role") == "assistant") & known, at(1)).alias("result_of"))
    arguments = F.to_json(F.struct(F.size(F.split(F.trim("text"), r"\s+")).alias("words"), F.col("text").alias("prompt")))
    calls = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.when(known, at(0)).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.when(known & (F.col("turn") >= 2), F.array(at(2))).alias("uses"))
    return messages, calls

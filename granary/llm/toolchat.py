"""Tool-call linking for chat formatting, with DataFrame functions only.

Calls and results meet in a hash join on the conversation and the call's identifier.  Calls of a
conversation are put in an order in which each stands after those it depends on, their
arguments are validated against the tool's schema, and call and result are written as canonical
JSON: keys sorted, no blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, places

#: Kinds of a schema's parameters, by the first word of the type that a value has as a variant.
KINDS = {"string": ["STRING"], "integer": ["BIGINT", "LONG", "INT"], "number": ["BIGINT", "LONG", "INT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and without blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conv_id, turn, role, text``.

    A message of role ``tool`` whose text is ``{"tool_call_id": .., "content": ..}`` is a result, and the entries
    of ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` in a message are calls.  Of all other
    messages an assistant's is the result of the turn before it, and any other one is a call of the
    tool named after its role, with the text and the turn as arguments, that depends on the call two turns before.
    """
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>,tool_call_id:string,content:string>"
    held = F.when(F.substring(F.ltrim("text"), 1, 1) == "{", F.from_json("text", kind))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", held.alias("held"))
    plain = rows.where(F.col("held.tool_calls").isNull() & F.col("held.tool_call_id").isNull())
    name = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
    arguments = F.concat(F.lit('{"text":'), F.coalesce(quoted(F.col("text")), F.lit("null")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    is_result = F.col("role").eqNullSafe("assistant")
    calls = plain.where(~is_result).select("conv_id", name(F.col("turn")).alias("call_id"), F.coalesce("role", F.lit("")).alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).alias("after"), F.col("turn").alias("pos"))
    inner = rows.where(F.col("held.tool_calls").isNotNull()).select("conv_id", "turn", F.explode("held.tool_calls").alias("c"))
    inner = inner.select("conv_id", F.col("c.id").alias("call_id"), F.coalesce("c.name", F.lit("")).alias("name"), "c.arguments", "c.after", F.col("turn").alias("pos"))
    results = plain.where(is_result).select("conv_id", name(F.col("turn") - 1).alias("call_id"), "text").unionByName(
        rows.where(F.col("held.tool_call_id").isNotNull()).select("conv_id", F.col("held.tool_call_id").alias("call_id"), F.coalesce("held.content", "text").alias("text"))
    )
    return calls.unionByName(inner), results


def _same_call(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a[left] == b[right])


def _levels(calls: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """Levels of the calls in conversations where some call depends on one that doesn't stand before it.

    ``conv_id, call_id, level`` of the calls that come after a dependency out of turn order: the most such
    dependencies on a way to the call (all others are level 0, and by ``pos`` in order), and ``conv_id, call_id``
    of those in or behind a cycle.  Only what is downstream of a dependency out of order is looked at: calls
    without open dependencies are peeled off until none can be.  Rounds grow with the longest chain there.
    """
    at = calls.groupBy("conv_id", "call_id").agg(F.min("pos").alias("pos"), F.max("pos").alias("end"))
    needs = calls.select("conv_id", "call_id", "pos", F.explode("after").alias("need"))
    target = at.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2"), F.col("pos").alias("p2"), F.col("end").alias("e2"))
    edges = scratch.write(needs.join(target, needs["conv_id"].eqNullSafe(target["c2"]) & (needs["need"] == target["i2"])).select("conv_id", "call_id", "pos", "need", "p2", "e2"), "edges")
    wrong = scratch.write(edges.where("p2 >= pos").select(F.col("conv_id").alias("w")).distinct(), "wrong")
    if wrong.isEmpty():
        return None, None
    edges = edges.join(wrong, edges["conv_id"].eqNullSafe(wrong["w"]), "left_semi")
    # A dependency counts unless all rows of the needed call stand before all of the call's.
    edges = scratch.write(edges.groupBy("conv_id", "call_id", "need").agg(F.max((F.col("e2") >= F.col("pos")).cast("long")).alias("counts")), "pairs")

    def meet(of: DataFrame, by: str, how: str = "inner") -> DataFrame:
        named = of.withColumnsRenamed({"conv_id": "c3", "call_id": "i3"})
        return edges_open.join(named, edges_open["conv_id"].eqNullSafe(named["c3"]) & (edges_open[by] == named["i3"]), how)

    edges_open = edges
    fresh = scratch.write(edges.where("counts > 0").select("conv_id", "call_id").distinct(), "behind0")
    behind, step = fresh, 0
    while not fresh.isEmpty():
        step += 1
        nxt = meet(fresh, "need").select("conv_id", "call_id").distinct()
        old = behind.withColumnsRenamed({"conv_id": "c4", "call_id": "i4"})
        fresh = scratch.write(nxt.join(old, nxt["conv_id"].eqNullSafe(old["c4"]) & (nxt["call_id"] == old["i4"]), "left_anti"), f"fresh{step}")
        behind = scratch.write(behind.unionByName(fresh), f"behind{step}")
        scratch.drop(f"behind{step - 1}", f"fresh{step - 1}")

    # Open: calls downstream that aren't peeled yet, with the level that their peeled dependencies ask for.
    # An edge is open as long as its need is; needs that aren't downstream have level 0.
    edges_open = edges
    inner = meet(behind, "need", "left_semi")
    base = edges.groupBy("conv_id", "call_id").agg(F.max("counts").alias("least"))
    todo = behind.withColumnsRenamed({"conv_id": "c5", "call_id": "i5"})
    base = base.join(todo, base["conv_id"].eqNullSafe(todo["c5"]) & (base["call_id"] == todo["i5"]), "left_semi")
    edges_open = scratch.write(inner, "open0")
    todo = scratch.write(base.select("conv_id", "call_id", F.col("least").alias("level")), "todo0")
    done, step = None, 0
    while True:
        held = edges_open.select(F.col("conv_id").alias("c4"), F.col("call_id").alias("i4")).distinct()
        free = scratch.write(todo.join(held, todo["conv_id"].eqNullSafe(held["c4"]) & (todo["call_id"] == held["i4"]), "left_anti"), f"free{step}")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        rest = todo.join(held, todo["conv_id"].eqNullSafe(held["c4"]) & (todo["call_id"] == held["i4"]), "left_semi")
        asked = meet(free, "need").groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("counts")).alias("up")).withColumnsRenamed({"conv_id": "c6", "call_id": "i6"})
        rest = rest.join(asked, rest["conv_id"].eqNullSafe(asked["c6"]) & (rest["call_id"] == asked["i6"]), "left").select("conv_id", "call_id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"))
        left = meet(free.select("conv_id", "call_id"), "need", "left_anti")
        step += 1
        todo, edges_open = scratch.write(rest, f"todo{step}"), scratch.write(left, f"open{step}")
        scratch.drop(f"todo{step - 1}", f"open{step - 1}")
        if step % 20 == 0:  # a plan of few tables
            done = scratch.write(done, f"done{step}")
    cyclic = todo.select(F.col("conv_id").alias("c4"), F.col("call_id").alias("i4"))
    return (todo.limit(0) if done is None else done), cyclic


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each call: ``conv_id, call_id, step, linked, cyclic, valid, errors, n_results, json``.

    ``calls`` has ``conv_id, call_id, name, arguments (JSON), after (ids it depends on), pos``, ``results``
    ``conv_id, call_id, text``, and ``schemas`` ``name, field, kind, required``.  ``step`` numbers the calls
    of a conversation from 0 in an order in which dependencies come first (by ``pos`` wherever that is such an order);
    calls in or behind a cycle come last and are ``cyclic``.  Of several results of a call the smallest text is taken and
    all are counted; calls without one have ``linked`` false and a null result.  Arguments that aren't a
    JSON object, lack a required field or hold one of another kind than the schema says give
    ``errors``, as does a name without a schema.  Null ids never link; null conversations are one conversation;
    repeated calls get a row each; empty tables give an empty result.
    """
    scratch = Scratch(calls.sparkSession, "toolchat")
    calls = scratch.write(calls, "calls")
    level, cyclic = _levels(calls, scratch)
    placed = calls.withColumn("level", F.lit(0)).withColumn("cyclic", F.lit(False))
    if level is not None:
        of = level.select(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2"), F.col("level").alias("l2"))
        placed = calls.join(of, calls["conv_id"].eqNullSafe(of["c2"]) & (calls["call_id"] == of["i2"]), "left").select(calls["*"], F.coalesce("l2", F.lit(0)).alias("level"))
        placed = placed.withColumn("cyclic", F.lit(False)) if cyclic is None else placed.join(cyclic.distinct().withColumn("cyclic", F.lit(True)), placed["conv_id"].eqNullSafe(F.col("c4")) & (placed["call_id"] == F.col("i4")), "left").drop("c4", "i4").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))

    # Steps by a sort of all conversations together, so that a conversation of any size is spread over partitions.
    stepped = places(placed, ["conv_id"], ["cyclic", "level", "pos", "call_id", "name", "arguments"], scratch, "steps", "step")

    # Schemas are one row for each tool: its name and its parameters.
    tools = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required")).alias("fields")).select(F.col("name").alias("tool"), F.array_sort("fields").alias("fields"))
    tools = scratch.write(tools, "tools")
    held = F.from_json("arguments", "map<string,variant>")
    checked = stepped.join(tools, stepped["name"] == tools["tool"], "left").withColumn("held", F.when(F.try_parse_json("arguments").isNotNull(), held))

    def fault(field: Column) -> Column:
        value = F.try_element_at(F.col("held"), field["field"])
        kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        allowed = F.coalesce(*[F.when(field["kind"] == k, F.array(*map(F.lit, v))) for k, v in KINDS.items()], F.array().cast("array<string>"))
        absent = value.isNull() | F.is_variant_null(value)
        return F.when(absent & field["required"], F.concat(F.lit("missing "), field["field"])).when(~absent & ~F.array_contains(allowed, kind), F.concat(F.lit("wrong kind of "), field["field"]))

    errors = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("held").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_compact(F.transform("fields", fault)))
    checked = checked.withColumn("errors", errors).drop("held", "fields", "tool")

    got = scratch.write(results.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("text").alias("result"), F.count("*").alias("n_results")).withColumnRenamed("conv_id", "c6").withColumnRenamed("call_id", "i6"), "results")
    joined = checked.join(got, checked["conv_id"].eqNullSafe(got["c6"]) & (checked["call_id"] == got["i6"]), "left").drop("c6", "i6")
    null = F.lit("null")
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), null), F.lit(',"call_id":'), F.coalesce(quoted(F.col("call_id")), null),
        F.lit(',"name":'), F.coalesce(quoted(F.col("name")), null), F.lit(',"result":'), F.coalesce(F.when(F.col("result").isNotNull(), quoted(F.col("result"))), null), F.lit("}"),
    )
    return joined.select(
        "conv_id", "call_id", F.col("step").cast("long").alias("step"), F.col("n_results").isNotNull().alias("linked"), "cyclic", (F.size("errors") == 0).alias("valid"),
        F.concat_ws("; ", "errors").alias("errors"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), json.alias("json"),
    )


SCHEMAS = [(role, field, kind, True) for role in ("system", "user") for field, kind in (("text", "string"), ("turn", "integer"))]


def report(messages: DataFrame) -> DataFrame:
    """The linked calls of ``conversations``, as ``turns_as_calls`` reads them."""
    calls, results = turns_as_calls(messages.select("conv_id", "turn", "role", "text"))
    values = ", ".join(f"('{name}', '{field}', '{kind}', {str(required).lower()})" for name, field, kind, required in SCHEMAS)
    schemas = messages.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(name, field, kind, required)")
    return link_tool_calls(calls, results, schemas)

"""Chat formatting: tool calls linked to their results, ordered, validated and serialised (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = 4096
#: For each JSON type of a schema, how the type of a parsed value begins.
TYPES = {"integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "string": ("STRING",), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}
CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
#: Tools known by default: name, then for each argument its type and whether it is required.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def argument_errors(c: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """The errors of a call (struct with name and args, a variant) against the schemas, in order."""
    none = F.array().cast("array<string>")
    known = F.array(*[F.lit(n) for n in schemas]) if schemas else none
    parts = [F.when(c["args"].isNull(), F.array(F.lit("arguments are not JSON"))), F.when(~F.array_contains(known, F.coalesce(c["name"], F.lit(""))), F.array(F.lit("unknown tool")))]
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(c["args"], f"$['{_quoted(field)}']", "variant"))
            right = F.lit(False)
            for start in TYPES[kind]:
                right = right | got.startswith(start)
            checks.append(F.when(got.isNull(), F.lit(f"missing {field}") if required else F.lit(None).cast("string")).when(~right, F.lit(f"{field} is not {kind}")))
        parts.append(F.when((c["name"] == name) & c["args"].isNotNull(), F.array(*checks) if checks else none))
    return F.array_compact(F.concat(*[F.coalesce(p, none) for p in parts]))


def format_chat(turns: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, position, linked_turn, status, message for every row of ``turns`` (conv_id, turn, role, text).

    An assistant's text that is a JSON object with ``tool_calls`` (id, name, arguments) makes calls; a
    text of role ``tool`` that is a JSON object with ``tool_call_id`` is a result. Calls and results are
    hash-joined by conversation and identifier; an identifier that occurs again belongs to its first
    call. In topological order a result comes right after its call and so before whatever follows
    the call, even where the rows come in another order; otherwise turns keep theirs. ``position`` counts
    from 0 in each conversation, ``linked_turn`` is the call's turn.

    ``message`` is canonical JSON: keys in order, no white space, arguments with keys in order.
    ``status`` is ok; for calls: no_result where some call has none, invalid with the arguments' errors;
    for results: orphan. Null text: content null. Null conv_id or identifier: never linked, and no result is missed. Rows with
    equal conv_id and turn (and repeated rows) keep an order by role and text. Empty table: no rows.
    Other columns are ignored; texts of any length are serialised whole. A long conversation is never in one
    task: positions are counted in segments of ``SEGMENT`` turns (rows of one turn are in one).
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    is_json = F.col("text").startswith("{")
    parsed = F.when((F.col("role") == "assistant") & is_json, F.from_json("text", CALLS))
    t = t.withColumn("parsed", parsed).withColumn("calls", F.coalesce(F.col("parsed.tool_calls"), F.array().cast("array<struct<id:string,name:string,arguments:string>>")))
    t = t.withColumn("id", F.when((F.col("role") == "tool") & is_json, F.get_json_object("text", "$.tool_call_id")))
    calls = t.where(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", F.col("c.id").alias("id"), "turn")
    first = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min("turn").alias("linked_turn"))
    answered = t.where("id is not null").select("conv_id", "id").distinct()
    open_ = first.join(answered, ["conv_id", "id"], "left_anti").select("conv_id", F.col("linked_turn").alias("turn")).distinct().withColumn("unanswered", F.lit(True))

    # only results are joined to calls and only calls to what is open, so that no other turn is dealt by a null key
    is_call, is_result = F.size("calls") > 0, F.col("id").isNotNull()
    results = t.where(is_result).join(first, ["conv_id", "id"], "left").withColumn("unanswered", F.lit(None).cast("boolean"))
    made = t.where(is_call).join(open_, ["conv_id", "turn"], "left").withColumn("linked_turn", F.lit(None).cast("long"))
    plain_ = t.where(~is_call & ~is_result).withColumns({"linked_turn": F.lit(None).cast("long"), "unanswered": F.lit(None).cast("boolean")})
    t = plain_.unionByName(results).unionByName(made)
    t = t.withColumn("at", F.coalesce("linked_turn", "turn")).withColumn("after", F.when(F.col("linked_turn").isNotNull(), 1).otherwise(0)).withColumn("segment", F.floor(F.col("at") / SEGMENT))
    ahead = t.groupBy("conv_id", "segment").agg(F.count("*").alias("n"))
    ahead = ahead.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), (F.sum("n").over(W.partitionBy("conv_id").orderBy(F.col("segment").asc_nulls_first())) - F.col("n")).alias("ahead"))
    t = t.withColumn("within", F.row_number().over(W.partitionBy("conv_id", "segment").orderBy("at", "after", "turn", "role", "text")) - 1)
    t = t.join(ahead, t["conv_id"].eqNullSafe(ahead["c"]) & t["segment"].eqNullSafe(ahead["s"]))

    def one(c: Column) -> Column:
        return F.struct(c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"), F.try_parse_json(c["arguments"]).alias("args"))

    t = t.withColumn("calls", F.transform("calls", one))
    errors = F.flatten(F.transform("calls", lambda c: argument_errors(c, schemas)))
    linked = F.transform("calls", lambda c: F.struct(F.coalesce(F.to_json(c["args"]), c["arguments"]).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    plain = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    calling = F.to_json(F.struct(F.col("parsed.content").alias("content"), F.col("role").alias("role"), linked.alias("tool_calls")), {"ignoreNullFields": "false"})
    result = F.to_json(F.struct(F.get_json_object("text", "$.content").alias("content"), F.col("role").alias("role"), F.col("id").alias("tool_call_id")), {"ignoreNullFields": "false"})
    has_calls = F.size("calls") > 0
    message = F.when(has_calls, calling).when(F.col("id").isNotNull(), result).otherwise(plain)
    status = F.when(has_calls & (F.size(errors) > 0), F.concat(F.lit("invalid: "), F.array_join(errors, "; "))).when(has_calls & F.col("unanswered"), "no_result")
    status = status.when(F.col("id").isNotNull() & F.col("linked_turn").isNull(), "orphan").otherwise("ok")
    return t.select("conv_id", "turn", (F.col("ahead") + F.col("within")).cast("long").alias("position"), "linked_turn", status.alias("status"), message.alias("message"))

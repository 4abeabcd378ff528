"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

Everything is a DataFrame or SQL expression. Calls and results meet in a hash join on conversation and identifier, so a
conversation of any length is spread by its identifiers. The order follows ``depends_on``: a call's level is the length
of its chain of dependencies, found by pointer doubling (each round joins every call to the one its pointer names and
adds the distances), so a chain of n calls takes log2(n) rounds; pointers that never end belong to cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basecov.session import stored

Schema = dict[str, dict[str, dict[str, object]]]
#: Names that variants give to the types of JSON schema. Fixed values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
MAX_ROUNDS = 64


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field_errors(name: str, rule: dict[str, object]) -> list[str]:
    """SQL that yields a message or NULL for one field of the variant ``args``."""
    path = _quoted(f"$['{name}']")
    there = f"array_contains(names, {_quoted(name)})"
    kind = f"schema_of_variant(try_variant_get(args, {path}, 'variant'))"
    fits = f"{kind} RLIKE {_quoted('^(' + TYPES[str(rule['type'])] + ')$')}"
    out = [f"CASE WHEN {there} AND NOT coalesce({fits}, false) THEN {_quoted('type: ' + name)} END"]
    if rule.get("required"):
        out.append(f"CASE WHEN NOT {there} THEN {_quoted('missing: ' + name)} END")
    if rule["type"] == "string":
        value = f"char_length(try_variant_get(args, {path}, 'string'))"
        bounds = (("minLength", "<"), ("maxLength", ">"))
    else:
        value, bounds = f"try_variant_get(args, {path}, 'double')", (("minimum", "<"), ("maximum", ">"))
    for bound, sign in bounds:
        if bound in rule:
            out.append(f"CASE WHEN {fits} AND {value} {sign} {rule[bound]} THEN {_quoted(f'{bound}: {name}')} END")
    return out


def errors(schemas: Schema) -> Column:
    """Messages, sorted, about ``name``, the variant ``args`` and its keys ``names``; an empty list for a valid call."""
    cases = []
    for tool, fields in schemas.items():
        known = ", ".join(_quoted(f) for f in fields)
        unknown = f"transform(array_except(names, array({known})), k -> concat('unknown: ', k))"
        rules = ", ".join(e for f, rule in fields.items() for e in _field_errors(f, rule))
        cases.append(f"WHEN name = {_quoted(tool)} THEN array_sort(array_compact(concat(array({rules}), {unknown})))")
    return F.expr(f"CASE WHEN names IS NULL THEN array('arguments: no object') {' '.join(cases)} ELSE array('tool: unknown') END")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of distinct calls (conv_id, call_id, depends_on); level is missing in cycles.

    A dependency that is missing or names no call of the conversation counts as none. Of repeated calls with several
    dependencies the smallest counts.
    """
    nodes = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("depends_on").alias("up"))
    known = nodes.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("there"))
    state = nodes.join(known, ["conv_id", "up"], "left").select("conv_id", "call_id", F.when(F.col("there"), F.col("up")).alias("up"))
    state = stored(state.withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "call-levels")
    open_calls = longest = state.where("up IS NOT NULL").count()  # no chain that ends is longer than all calls open now
    for round_ in range(MAX_ROUNDS):
        if not open_calls or 1 << round_ > longest:
            break  # pointers are 2^round steps long, so a chain still without end is a cycle
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        joined = state.join(above, ["conv_id", "up"], "left")
        state = stored(joined.select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "call-levels")
        open_calls = state.where("up IS NOT NULL").count()
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """A row per call, and per result without a call: ``conv_id, call_id, turn, level, status, errors, json``.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on. ``results``: conv_id, call_id, turn, content.

    ``status``: ``linked``; ``early`` if the result's turn is not after the call's; ``no result``; ``no call``. Of several
    results for one id the one with the smallest (turn, content) counts, and the others have a row each with the status
    ``repeated``; of repeated calls with one id every one gets the result. A missing conv_id or call_id links with nothing.
    ``errors`` are about the arguments; text that is no JSON object, or too large for a variant, is one error. ``level`` is
    the call's place in the order: every call has a higher level than the one it depends on; it is missing in cycles and for
    rows without a call. ``json`` has its keys in order, no spaces, and missing values as null. Other columns play no part.
    """
    first = W.partitionBy("conv_id", "call_id").orderBy("turn", "content")
    found = results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.row_number().over(first).alias("nth"))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    answer = found.where(known & (F.col("nth") == 1)).drop("nth")
    linked = calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on").join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    linked = linked.join(levels(calls), ["conv_id", "call_id"], "left")
    status = F.when(F.col("result_turn").isNull() & F.col("content").isNull(), "no result").when(F.col("result_turn") <= F.col("turn"), "early").otherwise("linked")
    parsed = linked.withColumn("status", status).withColumn("args", F.expr("try_parse_json(arguments)"))
    parsed = parsed.withColumn("names", F.expr("CASE WHEN schema_of_variant(args) LIKE 'OBJECT%' THEN json_object_keys(arguments) END"))
    checked = parsed.withColumn("errors", errors(schemas))
    ids = calls.where(known).select("conv_id", "call_id").distinct().withColumn("there", F.lit(True))
    alone = found.join(ids, ["conv_id", "call_id"], "left").withColumn("status", F.when(F.col("there").isNull(), "no call").when(F.col("nth") > 1, "repeated")).where("status IS NOT NULL")
    nothing = F.lit(None)
    alone = alone.select("conv_id", "call_id", F.col("result_turn").alias("turn"), nothing.cast("string").alias("name"), F.expr("CAST(NULL AS VARIANT)").alias("args"), nothing.cast("string").alias("depends_on"), "content", nothing.cast("long").alias("level"), "status", F.expr("CAST(array() AS array<string>)").alias("errors"))
    rows = checked.select(*alone.columns).unionByName(alone)
    canonical = F.to_json(F.struct(F.col("args").alias("arguments"), "call_id", "conv_id", "depends_on", "errors", "level", "name", F.col("content").alias("result"), "status", "turn"), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "call_id", "turn", "level", "status", "errors", canonical.alias("json"))

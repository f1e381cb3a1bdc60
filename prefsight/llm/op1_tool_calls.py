"""Tool-call linking: results joined to calls by identifier, checked and ordered.

* Results are joined to calls by (conversation, call identifier) in a shuffled
  hash join; of several results of a call the earliest counts, the rest are counted.
* Arguments are validated against the tool's JSON schema and may refer to the
  result of another call as ``{"$ref": "<call id>"}``.
* Calls are ordered topologically: round by round, the calls whose references are
  all ordered get the next level.  A round is a join over the references that
  are left, so a conversation with very many calls is never gathered; there are
  as many rounds as the longest chain of references.  Calls on a cycle, or that
  refer to an unknown call, stay unresolved and come last.
* Each call becomes one record of canonical JSON (sorted keys, no white space,
  shortest numbers), equal for equal content.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.operators.indexing import index_within_group
from prefsight.session import ensure_checkpoint_dir

#: Schemas are broadcast up to this many characters in all; beyond, they are joined.
BROADCAST_CHARS = 8 << 20
#: Rounds of topological levels between checkpoints.
LEVEL_ROUNDS = 8


# --- canonical JSON ---------------------------------------------------------

def _number(x) -> str:
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    e = int(exponent)
    if -7 < e < 0:
        return f"{x:.{len(digits.replace('-', '').replace('.', '')) - 1 - e}f}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value) -> str:
    """JSON with keys in UTF-16 order, no white space and ECMAScript numbers."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


# --- schemas ----------------------------------------------------------------

_TYPES = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v == int(v),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "null": lambda v: v is None,
}


def _is_reference(value) -> bool:
    return isinstance(value, dict) and value.keys() == {"$ref"} and isinstance(value["$ref"], str)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a value a schema forbids, in order of the schema's keywords.

    Keywords: type, enum, const, required, properties, additionalProperties, items,
    minimum, maximum, minLength, maxLength, minItems, maxItems.  A reference to a
    call's result fits any schema.
    """
    if _is_reference(value):
        return []
    found = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {canonical(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not one of {canonical(schema['enum'])}")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not {canonical(schema['const'])}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below {canonical(schema['minimum'])}")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above {canonical(schema['maximum'])}")
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            found.append(f"{at}: shorter than {schema[low]}")
        if len(value) > schema.get(high, len(value)):
            found.append(f"{at}: longer than {schema[high]}")
    if isinstance(value, dict):
        found += [f"{at}: lacks {k}" for k in schema.get("required", ()) if k not in value]
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}: unknown {k}")
            elif isinstance(schema.get("additionalProperties"), dict):
                found += violations(value[k], schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}[{i}]")
    return found


def references(value) -> list[str]:
    """Identifiers of the calls whose results a value refers to."""
    if _is_reference(value):
        return [value["$ref"]]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return sorted({r for v in inner for r in references(v)})


def _checked(batches: Iterator[pa.RecordBatch]):
    schemas: dict[str, dict] = {}
    for batch in batches:
        names = batch.schema.names
        args, raw = (batch.column(names.index(c)).to_pylist() for c in ("arguments", "schema"))
        form, errors, refs = [], [], []
        for a, s in zip(args, raw, strict=True):
            try:
                value = json.loads(a) if a is not None else None
                text = canonical(value)
            except (ValueError, RecursionError):
                form.append(None)
                errors.append(["$: not JSON"])
                refs.append([])
                continue
            if s is not None and s not in schemas:
                schemas[s] = json.loads(s)
            form.append(text)
            errors.append(["$: unknown tool"] if s is None else violations(value, schemas[s]))
            refs.append(references(value))
        keep = [i for i, n in enumerate(names) if n not in ("arguments", "schema")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(form, pa.string()),
             pa.array(errors, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string()))],
            names=[*(names[i] for i in keep), "arguments", "errors", "refs"])


def _records(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = batch.to_pylist()
        out = [canonical({**{k: r[k] for k in ("call_id", "conv_id", "errors", "name", "position", "result", "status")},
                          "arguments": None if r["arguments"] is None else json.loads(r["arguments"])}) for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())],
                                         names=[*batch.schema.names, "record"])


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the nodes that can be ordered; roots have level 0.

    ``edges`` (conv_id, call_id, ref) say that a call comes after ``ref``.  A round
    resolves one level; the levels are checkpointed every LEVEL_ROUNDS rounds, so the
    plan of a long chain does not grow with it.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    key = ["conv_id", "call_id"]
    pending = edges.select("conv_id", "call_id", "ref").distinct().checkpoint()
    frontier = nodes.select(*key).distinct().join(pending, key, "left_anti").checkpoint()
    levels, level = frontier.withColumn("level", F.lit(0)), 0
    while frontier.count():
        left = pending.join(frontier.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"],
                            "left_anti").select("conv_id", "call_id", "ref").checkpoint()
        level += 1
        frontier = (pending.select(*key).distinct().join(left, key, "left_anti")
                    .join(nodes.select(*key), key, "left_semi").checkpoint())
        levels = levels.union(frontier.withColumn("level", F.lit(level)))
        if level % LEVEL_ROUNDS == 0:
            levels = levels.checkpoint()
        pending = left
    return levels


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its result, checks, place and canonical record.

    ``calls`` has (conv_id, call_id, turn, name, arguments), ``results`` (conv_id,
    call_id, turn, content), ``schemas`` (name, schema); arguments and schemas are
    JSON text.  Other columns are not read.

    status: ``linked``; ``no_result``; ``early_result`` if the earliest result comes
    before the call; ``duplicate`` for calls that repeat an identifier (only the
    earliest by turn, name and arguments takes the result); ``no_id`` if the
    conversation or the identifier is null.  n_results counts the results with the
    identifier.  Null or malformed arguments and unknown tools are errors; a name
    with several schemas takes the least.  level is the topological level (null if
    unresolved), position the place in the conversation by level (unresolved last),
    turn, identifier, name and arguments.  No calls give no rows; results without a
    call are found by ``orphan_results``.
    """
    ensure_checkpoint_dir(calls.sparkSession)
    tools = schemas.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema")).checkpoint()
    small = (tools.agg(F.coalesce(F.sum(F.length("schema") + F.length("name")), F.lit(0))).first()[0]
             <= BROADCAST_CHARS)
    rows = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.join(F.broadcast(tools) if small else tools, "name", "left").select(
        "conv_id", "call_id", "turn", "name", "arguments", "schema")
    checked = rows.mapInArrow(_checked, f"conv_id {conv}, call_id string, turn bigint, name string, "
                                        "arguments string, errors array<string>, refs array<string>")
    checked = checked.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    known = checked.where("conv_id is not null and call_id is not null")
    first = known.groupBy("conv_id", "call_id").agg(F.min(F.struct(
        F.coalesce("turn", F.lit(2**62)).alias("t"), "name", "arguments", "row")).alias("m")).select("conv_id", "call_id", "m.row")

    answers = (results.where("conv_id is not null and call_id is not null")
               .groupBy("conv_id", F.col("call_id").cast("string").alias("call_id"))
               .agg(F.min(F.struct(F.coalesce("turn", F.lit(2**62)).cast("long").alias("t"),
                                   F.col("content").cast("string").alias("content"))).alias("r"),
                    F.count(F.lit(1)).alias("n_results")))
    edges = known.join(first, ["conv_id", "call_id", "row"], "left_semi").select(
        "conv_id", "call_id", F.explode("refs").alias("ref"))
    levels = topological_levels(first, edges)
    taken = (first.join(answers, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "call_id"], "left")
             .select("row", F.lit(True).alias("is_first"), "r", "n_results", "level"))
    out = checked.join(taken, "row", "left")
    status = (F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id")
              .when(F.col("is_first").isNull(), "duplicate").when(F.col("r").isNull(), "no_result")
              .when(F.col("r.t") < F.col("turn"), "early_result").otherwise("linked"))
    out = out.select("conv_id", "call_id", "turn", "name", "arguments", "errors", status.alias("status"),
                     F.col("r.content").alias("result"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
                     "level", F.coalesce("level", F.lit(2**31 - 1)).alias("__order"), "row")
    out = index_within_group(out, ["conv_id"], ["__order", "turn", "call_id", "name", "arguments", "row"], "position")
    out = out.select("conv_id", "call_id", "turn", "name", "arguments", "errors", "status", "result", "n_results",
                     "level", "position")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields) + ", record string"
    return out.mapInArrow(_records, schema)


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose (conv_id, call_id) no call has, null ones included."""
    ids = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id")).distinct()
    return results.join(ids, (results["conv_id"] == ids["conv_id"])
                        & (results["call_id"].cast("string") == ids["call_id"]), "left_anti")


# --- conversations as calls -------------------------------------------------

def _tool(**properties) -> str:
    return canonical({"type": "object", "required": ["query", "words"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1},
        "context": {"type": "object"}, **properties}})


#: Tools that the turns of a conversation call, and their schemas.
TOOLS = {"search": _tool(words={"type": "integer", "minimum": 1, "maximum": 60}),
         "lookup": _tool(context={"type": "object"}), "configure": _tool(query={"type": "string", "maxLength": 400})}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of turns (conv_id, turn, role, text).

    A user's turn calls ``search`` (``lookup`` below 20 words), any other but an
    assistant's calls ``configure``; an assistant's turn is the result of the turn
    before it.  The k-th call of a conversation refers to the (k // 2)-th as its
    context, a tree whose depth is the logarithm of the calls.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    spoken = F.coalesce(F.col("role") == "assistant", F.lit(False))
    results = turns.where(spoken).select("conv_id", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"),
                                         "turn", F.col("text").alias("content"))
    calls = turns.where(~spoken).withColumn("call_id", F.concat(F.lit("call-"), F.col("turn")))
    calls = index_within_group(calls, ["conv_id"], ["turn", "role", "text"], "k").checkpoint()
    parents = calls.select(F.col("conv_id").alias("pc"), (F.col("k") + 1).alias("pk"), F.col("call_id").alias("parent"))
    # (conversation, place) is unique, so a long conversation spreads over the join.
    calls = calls.join(parents, (F.col("conv_id") == F.col("pc")) & (F.floor((F.col("k") + 1) / 2) == F.col("pk")), "left")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    name = F.when(F.col("role") == "user", F.when(words < 20, "lookup").otherwise("search")).otherwise("configure")
    context = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("$ref")))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.alias("words"), context.alias("context")))
    return calls.select("conv_id", "call_id", "turn", name.alias("name"), arguments.alias("arguments")), results

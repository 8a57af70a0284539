"""Tool calls of chats: linked to their results, ordered, validated, serialised.

A chat is rows ``(conversation, turn, role, text)``. An assistant's text that is a JSON object with
``tool_calls`` makes calls ``{id, name, arguments, after}``; a tool's text is a JSON object
``{tool_call_id, content}``. Calls and results meet in a hash join on conversation, id and the
how-manieth use of the id. The order of calls respects ``after``, the ids that a call builds on: where
all of them come earlier, the turns are that order already; only calls that name later ones are
moved, level by level. Arguments are checked against the tools' JSON schemas, and every message
becomes one line of canonical JSON: keys sorted, no blanks, UTF-8.

No conversation is gathered in one task: rows stay rows, so one with a third of all turns is work
for as many tasks as any other.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, trimmed

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: Characters of all tool schemas together at most; they travel with the tasks.
SCHEMAS = 4 << 20

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Half a surrogate pair, which UTF-8 cannot hold.
_HALF = re.compile("[\ud800-\udfff]")


def _encodable(text: str) -> str:
    return _HALF.sub(lambda c: f"\\u{ord(c.group()):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no needless escapes; whole floats as whole numbers, half a surrogate pair as its escape."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x.is_integer() and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _encodable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


#: Keywords that :func:`violations` checks, and those that say nothing about a value.
_BOUNDS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"}
_CHECKED = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "uniqueItems", "allOf", "anyOf", "oneOf", "not"} | _BOUNDS
_REMARKS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}


def check_schema(schema, at: str = "$") -> None:
    """Raises ValueError for a schema with a keyword that :func:`violations` cannot check."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object or a boolean")
    for k in schema.keys() - _CHECKED - _REMARKS:
        raise ValueError(f"{at}: the keyword {k!r} is not supported")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES and kind not in ("integer", "number"):
            raise ValueError(f"{at}: the type {kind!r} is not supported")
    if any(k in schema and (isinstance(schema[k], bool) or not isinstance(schema[k], int | float) or not math.isfinite(schema[k])) for k in _BOUNDS):
        raise ValueError(f"{at}: bounds must be numbers")
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{at}: multipleOf must be above 0")
    for k in ("additionalProperties", "items", "not"):
        if k in schema:
            check_schema(schema[k], f"{at}.{k}")
    for k, v in schema.get("properties", {}).items():
        check_schema(v, f"{at}.{k}")
    for k in ("allOf", "anyOf", "oneOf"):
        for i, v in enumerate(schema.get(k, [])):
            check_schema(v, f"{at}.{k}[{i}]")


def _multiple(value, of) -> bool:
    """By the decimals as they are written; infinity, which Python reads from large numbers, is a multiple of nothing."""
    exact = lambda x: Fraction(x) if isinstance(x, int) else Fraction(str(x))
    return (isinstance(value, int) or math.isfinite(value)) and exact(value) % exact(of) == 0


def _arguments(text: str | None) -> tuple[object, bool]:
    """The arguments of a call, and whether they are a JSON object; what nests too deeply to be read is none."""
    if text is None:
        return {}, True
    try:
        value = json.loads(text)
        canonical(value)
        return value, isinstance(value, dict)
    except (ValueError, RecursionError):  # numbers of more digits than Python reads are a ValueError too
        return text, False


def violations(value, schema: dict | bool, at: str = "$") -> list[str]:
    """Where a value breaks a schema, of the keywords that :func:`check_schema` lets pass."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    out: list[str] = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def fits(kind: str) -> bool:
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if kind == "integer":
            return number and (isinstance(value, int) or value.is_integer())
        return number if kind == "number" else isinstance(value, _TYPES.get(kind, object))

    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    # compared as JSON, where true is not 1
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, int | float) and not isinstance(value, bool):
        out += [f"{at}: {k}" for k, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b), ("exclusiveMinimum", lambda b: value <= b), ("exclusiveMaximum", lambda b: value >= b), ("multipleOf", lambda b: not _multiple(value, b))) if k in schema and bad(schema[k])]
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", lambda b: len(value) < b), ("maxLength", lambda b: len(value) > b)) if k in schema and bad(schema[k])]
    if isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", lambda b: len(value) < b), ("maxItems", lambda b: len(value) > b)) if k in schema and bad(schema[k])]
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: uniqueItems")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k}" for k, bad in (("minProperties", lambda b: len(value) < b), ("maxProperties", lambda b: len(value) > b)) if k in schema and bad(schema[k])]
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
            elif k not in known:
                out += violations(value[k], schema.get("additionalProperties", True), f"{at}.{k}")
    for part in schema.get("allOf", []):
        out += violations(value, part, at)
    for k, right in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if k in schema and not right(sum(not violations(value, part, at) for part in schema[k])):
            out.append(f"{at}: {k}")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: not")
    return out


def _levels(ws: Workspace, calls: DataFrame) -> DataFrame:
    """``(conv, key, level)`` of the calls of conversations in which a call names a later one; -1 in a circle.

    ``calls`` is ``(conv, key, id, after)``, the key in the order of the turns. A level is the longest way
    down to a call that names none. Chains of calls that name one other are followed by pointer
    jumping, in as many rounds as the logarithm of their length; only calls that name several are
    settled level by level.
    """
    ids = calls.groupBy("conv", "id").agg(F.min("key").alias("need"))
    named = calls.select("conv", "key", F.explode("after").alias("id")).join(ids, ["conv", "id"]).select("conv", "key", "need").distinct()
    late = ws.table(named.where("need >= key").select("conv").distinct(), "late")
    if late.isEmpty():
        return calls.where("false").select("conv", "key", F.lit(0).alias("level"))
    edges = ws.table(named.join(late, "conv", "left_semi"), "edges")
    needs = edges.groupBy("conv", "key").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    nodes = calls.join(late, "conv", "left_semi").select("conv", "key").join(needs, ["conv", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.col("n") == 1
    ways = ws.table(nodes.select("conv", "key", "n", F.when(one, F.col("need")).otherwise(F.col("key")).alias("end"), one.cast("int").alias("steps")), "ways")
    longest = ways.groupBy("conv").count().agg(F.max("count")).head()[0]
    for _ in range(max(1, longest).bit_length()):
        on = ways.select("conv", F.col("key").alias("end"), F.col("end").alias("beyond"), F.col("steps").alias("more"))
        ways = ws.table(ways.join(on, ["conv", "end"]).select("conv", "key", "n", F.col("beyond").alias("end"), (F.col("steps") + F.col("more")).alias("steps")), "ways")
    # an end that still names one other is on a circle
    settled = ws.table(ways.where("n = 0").select("conv", "key", F.lit(0).alias("level")), "settled")
    several = ways.where("n > 1").select("conv", "key")
    reach = ws.table(edges.join(several, ["conv", "key"], "left_semi").join(ways.select("conv", F.col("key").alias("need"), "end", "steps"), ["conv", "need"]).select("conv", "key", "end", "steps"), "reach")
    while not reach.isEmpty():
        found = settled.select("conv", F.col("key").alias("end"), "level")
        ready = reach.join(found, ["conv", "end"], "left").groupBy("conv", "key").agg(F.max(F.col("steps") + F.col("level") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
        ready = ws.table(ready.where("all").select("conv", "key", "level"), "ready")
        if ready.isEmpty():
            break
        settled = ws.table(settled.unionByName(ready), "settled")
        reach = ws.table(reach.join(ready, ["conv", "key"], "left_anti"), "reach")
    ends = settled.select("conv", F.col("key").alias("end"), "level")
    return ws.table(ways.join(ends, ["conv", "end"], "left").select("conv", "key", F.coalesce((F.col("level") + F.col("steps")).cast("int"), F.lit(-1)).alias("level")), "levels")


def link_tool_calls(messages: DataFrame, tools: dict[str, dict] | None = None, conversation_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conversation, turn, idx, kind, call_id, status, level, violations, json)``: one row for each message and call.

    ``kind`` is message, call or result. A call is ``linked`` with its result (whose content its JSON
    has) or ``unanswered``; a result without a call is an ``orphan``; a linked result makes no row of its
    own. The n-th result of an id belongs to its n-th call. Rows are in order by ``level`` (null: as the
    turns are; -1: calls that wait for each other, after the others), turn and ``idx``. ``violations`` is null
    for calls of unknown tools; a schema with a keyword that cannot be checked raises ValueError. A call
    without an id is unanswered. What an assistant's JSON says beside its calls is a message of its own, with
    ``idx`` -1, before them; an empty list of calls makes a message of the whole text. Texts that are no such JSON are messages, a null text has content null,
    arguments that are no JSON object are a violation and kept as a string. A null conversation or turn
    makes a message; rows of a repeated turn are kept, in the order of their texts' hashes. Numbers of any size, half
    surrogate pairs and deep nesting are no errors: what Python cannot read as JSON is kept as a string and is a violation.
    """
    schemas = tools or {}
    if len(json.dumps(schemas)) > SCHEMAS:
        raise ValueError(f"the schemas have over {SCHEMAS} characters")
    for name, schema in schemas.items():
        check_schema(schema, name)
    ws = Workspace(messages.sparkSession, "tool-calls")
    src = messages.select(F.col(conversation_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keyed = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    object_like = F.col("text").rlike(r"^\s*\{")
    made = F.when(keyed & (F.col("role") == "assistant") & object_like, F.from_json("text", CALLS)["tool_calls"])
    got = F.when(keyed & (F.col("role") == "tool") & object_like, F.from_json("text", RESULT))
    rows = ws.table(src.withColumn("made", made).withColumn("got", got), "messages")
    plain = rows.where("(made is null or size(made) = 0) and got.tool_call_id is null")
    beside = F.map_filter(F.from_json("text", "map<string,string>"), lambda k, v: (k != "tool_calls") & v.isNotNull())
    spoken = rows.where("size(made) > 0").where(F.size(beside) > 0)
    calls = rows.where("made is not null").select("conv", "turn", F.xxhash64("text").alias("tie"), F.posexplode("made").alias("idx", "c"))
    calls = calls.select("conv", "turn", "tie", "idx", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    results = rows.where("got.tool_call_id is not null").select("conv", F.col("turn").alias("result_turn"), F.col("got.tool_call_id").alias("id"), F.col("got.content").alias("content"))
    use = lambda *order: F.row_number().over(Window.partitionBy("conv", "id").orderBy(*order))  # noqa: E731  uses of one id
    calls = ws.table(calls.withColumn("use", use("turn", "tie", "idx")).withColumn("key", F.struct("turn", "idx", "tie", "use")), "calls")
    results = results.withColumn("use", use("result_turn", "content"))
    joined = calls.join(results, ["conv", "id", "use"], "full_outer")
    levels = _levels(ws, calls.select("conv", "key", "id", "after"))
    joined = joined.join(levels, ["conv", "key"], "left")
    kind = F.when(F.col("turn").isNotNull(), "call").otherwise("result")
    status = F.when(F.col("turn").isNull(), "orphan").when(F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    linked = joined.select("conv", F.coalesce("turn", "result_turn").alias("turn"), F.coalesce("idx", F.lit(0)).alias("idx"), kind.alias("kind"), F.col("id").alias("call_id"), status.alias("status"), "level", F.lit(None).cast("string").alias("role"), "name", "arguments", "content")
    none = F.lit(None).cast("string")
    tell = lambda df, idx, kind: df.select("conv", "turn", F.lit(idx).alias("idx"), F.lit(kind).alias("kind"), none.alias("call_id"), none.alias("status"), F.lit(None).cast("int").alias("level"), "role", none.alias("name"), none.alias("arguments"), F.col("text").alias("content"))
    told = tell(plain, 0, "message").unionByName(tell(spoken, -1, "beside"))

    @trimmed
    def run(batches):
        for batch in batches:
            lines, broken = [], []
            kinds = ["message" if k == "beside" else k for k in batch["kind"].to_pylist()]
            for r in batch.to_pylist():
                found = None
                if r["kind"] == "message":
                    value = {"role": r["role"], "content": r["content"]}
                elif r["kind"] == "beside":
                    try:
                        value = {"role": r["role"]} | {k: v for k, v in json.loads(r["content"], strict=False).items() if k != "tool_calls"}
                        canonical(value)
                    except (ValueError, RecursionError):  # Spark reads some texts that are not quite JSON, or nest deeper
                        value = {"role": r["role"], "content": r["content"]}
                elif r["kind"] == "result":
                    value = {"role": "tool", "tool_call_id": r["call_id"], "content": r["content"]}
                else:
                    arguments, sound = _arguments(r["arguments"])
                    if r["name"] in schemas:
                        found = [*map(_encodable, violations(arguments, schemas[r["name"]]))] if sound else ["$: not an object"]
                    value = {"id": r["call_id"], "name": r["name"], "arguments": arguments}
                    if r["status"] == "linked":
                        value["result"] = r["content"]
                lines.append(canonical(value))
                broken.append(found)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv", "turn", "idx")), pa.array(kinds, pa.string()), *(batch[c] for c in ("call_id", "status", "level")), pa.array(broken, pa.list_(pa.string())), pa.array(lines, pa.string())], names=["conv", "turn", "idx", "kind", "call_id", "status", "level", "violations", "json"])

    out = linked.unionByName(told)
    schema = f"conv {src.schema['conv'].dataType.simpleString()}, turn long, idx int, kind string, call_id string, status string, level int, violations array<string>, json string"
    return out.mapInArrow(run, schema).withColumnsRenamed({"conv": conversation_col, "turn": turn_col})

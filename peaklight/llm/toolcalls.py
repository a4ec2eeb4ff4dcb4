"""Tool calls of conversations: linked to their results, ordered, validated, in canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklight.llm._base import Stage, join_counted

#: A string argument of this form refers to the result of another call of the conversation.
REFERENCE = r'"\$ref:([^"]+)"'

#: Depth of nested arrays and objects, and digits of a whole number, that arguments may have.
DEEP, DIGITS = 256, 4300

_TYPES = {"string": str, "integer": (int, float), "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Keywords of a schema that are checked, and those that only describe.
CHECKED = {"type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum"}
DESCRIBE = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}


def check_schema(schema: dict, at: str = "$") -> None:
    """Raise a ValueError where a schema asks for something that schema_errors() wouldn't look at."""
    unknown = set(schema) - CHECKED - DESCRIBE
    kinds = schema.get("type", [])
    if unknown or not set([kinds] if isinstance(kinds, str) else kinds) <= set(_TYPES):
        raise ValueError(f"{at}: keywords or types that aren't known: {sorted(unknown) or kinds}")
    if not isinstance(schema.get("additionalProperties", True), bool) or not isinstance(schema.get("items", {}), dict):
        raise ValueError(f"{at}: additionalProperties must be true or false, items one schema")
    for k, own in schema.get("properties", {}).items():
        check_schema(own, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or not isinstance(value, float) or value.is_integer())


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What a JSON value lacks of a schema: type, enum, required, properties, additionalProperties, items, minimum, maximum.

    As in JSON Schema 1.0 is an integer, and true equals no number.
    """
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    return out


def _shown(text: str) -> str:
    """Lone surrogates, which no encoding has, as the escapes that stand for them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _whole(value):
    """Numbers without a fraction as whole ones, so that equal values are written alike."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    if isinstance(value, dict):
        return {k: _whole(v) for k, v in value.items()}
    return [_whole(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; characters outside ASCII stand for themselves, lone surrogates as escapes; 1.0 is written 1."""
    return _shown(json.dumps(_whole(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


class OutOfRange(ValueError):
    pass


def _float(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise OutOfRange
    return x


def _int(text: str) -> int:
    if len(text.lstrip("-")) > DIGITS:
        raise OutOfRange
    return int(text)


def _no_json(name: str):
    raise ValueError(name)  # NaN and Infinity


def _too_deep(value) -> bool:
    level = [value]
    for _ in range(DEEP + 1):
        level = [y for x in level if isinstance(x, (dict, list)) for y in [None, *(x.values() if isinstance(x, dict) else x)]]
    return bool(level)


def read_arguments(text: str | None):
    """(value, None) of JSON text, or (None, what is wrong with it)."""
    try:
        value = json.loads(text, parse_constant=_no_json, parse_float=_float, parse_int=_int)
    except OutOfRange:
        return None, "$: number out of range"
    except RecursionError:
        return None, "$: nested too deeply"
    except (TypeError, ValueError):
        return None, "$: not JSON"
    return (None, "$: nested too deeply") if _too_deep(value) else (value, None)


def _checked(tools: dict[str, dict]) -> Column:
    @F.pandas_udf("canonical string, errors array<string>")
    def check(ids: pd.Series, names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        rows = []
        for i, name, text in zip(ids, names, arguments, strict=True):
            value, wrong = read_arguments(text)
            if wrong:
                rows.append((None, [wrong]))
                continue
            errors = schema_errors(value, tools[name]) if name in tools else ["$: unknown tool"]
            rows.append((canonical({"arguments": value, "id": i, "name": name}), list(map(_shown, errors))))
        return pd.DataFrame(rows, columns=["canonical", "errors"])

    return check("call_id", "name", "arguments")


def _kahn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of whole conversations; their edges (conv_id, uid, ref) come one conversation after the other."""

    def solve(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        waits, users = Counter(u for u, _ in edges), defaultdict(list)
        for u, r in edges:
            users[r].append(u)
        level = {r: 0 for r in users if r not in waits}
        todo = list(level)
        for r in todo:  # grows while it is read
            for u in users.get(r, ()):
                level[u] = max(level.get(u, 0), level[r] + 1)
                waits[u] -= 1
                if not waits[u]:
                    todo.append(u)
        rows = [(u, -1 if n else level[u]) for u, n in waits.items()]
        return pa.RecordBatch.from_pydict({"uid": pa.array([u for u, _ in rows], pa.int64()), "level": pa.array([x for _, x in rows], pa.int64())})

    held, last = [], None
    for batch in batches:
        for conv, u, r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "uid", "ref")), strict=True):
            if conv != last and len(held) > 50_000:
                yield solve(held)
                held = []
            held.append((u, r))
            last = conv
    if held:
        yield solve(held)


def _contracted(edges: DataFrame, stage: Stage) -> DataFrame:
    """uid, level from edges (uid, ref) of conversations too large for one task.

    Each round settles the calls that wait for nothing, and lets every edge to a call with one open
    reference jump over it, so a chain of n calls takes about log2(n) rounds.  A round that settles
    nothing leaves only calls on or behind a cycle: level -1.
    """
    edges = stage(edges.select("uid", "ref").distinct().withColumn("w", F.lit(1).cast("long")), "edges")
    start = edges
    new = stage(edges.select(F.col("ref").alias("uid")).distinct().join(edges.select("uid"), "uid", "left_anti").withColumn("level", F.lit(0).cast("long")), "settled")
    base, done, stale = None, [], []
    while not new.isEmpty():
        hit = edges.join(new.select(F.col("uid").alias("ref"), "level"), "ref").select("uid", (F.col("level") + F.col("w")).alias("b"))
        base = stage((hit if base is None else hit.unionByName(base)).groupBy("uid").agg(F.max("b").alias("b")), "base")
        stage.drop(*stale)
        base_table, left = base, edges.join(new.select(F.col("uid").alias("ref")), "ref", "left_anti")
        one = left.groupBy("uid").agg(F.count("*").alias("k"), F.first("ref").alias("to"), F.first("w").alias("far")).where("k = 1").join(base, "uid", "left").select(F.col("uid").alias("ref"), "to", "far", "b")
        jumped = stage(left.join(one, "ref", "left").select("uid", F.coalesce("to", "ref").alias("ref"), F.least(F.col("w") + F.coalesce("far", F.lit(0)), F.lit(1 << 40)).alias("w"), (F.col("b") + F.col("w")).alias("b")), "jumped")
        new = stage(base.join(jumped.select("uid"), "uid", "left_anti").select("uid", F.col("b").alias("level")), "settled")
        done.append(new)
        base = jumped.where("b is not null").select("uid", "b").unionByName(base.join(new, "uid", "left_anti"))
        stale = [base_table, jumped, *([edges] if edges is not start else [])]
        edges = stage(jumped.groupBy("uid", "ref").agg(F.max("w").alias("w")), "edges")
    stage.drop(*stale, *([edges] if edges is not start else []))
    known = reduce(DataFrame.unionByName, done) if done else new
    return start.select("uid").distinct().join(known, "uid", "left").select("uid", F.coalesce("level", F.lit(-1)).alias("level"))


def _levels(edges: DataFrame, stage: Stage, most: int) -> DataFrame:
    """uid, level of the calls that refer to others: conversations of up to ``most`` references each in one task, larger ones by rounds."""
    counts = edges.groupBy("conv_id").agg(F.count("*").alias("n"))
    edges = stage(join_counted(edges, counts.withColumn("size", F.col("n")), "conv_id"), "edges")
    some = edges.where(F.col("size") <= most).select("conv_id", "uid", "ref").repartition("conv_id").sortWithinPartitions("conv_id")
    out = some.mapInArrow(_kahn, "uid long, level long")
    many = edges.where(F.col("size") > most)
    return out if many.isEmpty() else out.unionByName(_contracted(many, stage))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict[str, dict], most: int = 100_000) -> DataFrame:
    """One row per call.

    calls: conv_id, turn, call_id, name, arguments (JSON text); results:
    conv_id, turn, call_id, content; tools: JSON schema of the arguments by name.
    Returns conv_id, turn, call_id, name, result_turn and content of the first
    result with its identifier (null without one), n_results, level, errors
    (array of text) and canonical, the call as canonical JSON (null if the arguments aren't JSON).

    A call may refer to another of its conversation ("$ref:<id>" in its arguments).  The level is
    the number of calls in the longest chain of references behind it: 0 without references to
    calls at hand, -1 on or behind a cycle.  Calls in order of (level, turn) are in
    topological order.

    Results are folded by identifier before the hash join, so many results of one
    call stay one row.  Of calls that share an identifier in a conversation the first by turn
    (then name, arguments; of equal rows one) is linked and referred to; the others have error "$: identifier used before".
    A null identifier or conversation links with nothing, and its references lead to no call.  Empty tables give no rows;
    other columns than those named are left out; a text of any length is read whole.

    Arguments that aren't JSON (NaN and Infinity are none) have the error "$: not JSON", those with a number that no double or no DIGITS digits hold "$: number out of range",
    those with more than DEEP levels "$: nested too deeply"; none of these has a canonical form.  Of keys that repeat in an object the last counts.
    A lone surrogate stays an escape.  A schema with keywords that aren't checked (CHECKED, DESCRIBE) is a ValueError at once.
    """
    for name, schema in tools.items():
        check_schema(schema, name)
    stage = Stage(calls.sparkSession, "toolcalls")
    calls = stage(calls.select("conv_id", "turn", "call_id", "name", "arguments").withColumn("uid", F.monotonically_increasing_id()), "calls")
    keyed = ["conv_id", "call_id"]
    folded = results.where("call_id is not null").groupBy(*keyed).agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n"))
    owner = stage(calls.where("call_id is not null and conv_id is not null").groupBy(*keyed).agg(F.min(F.struct("turn", "name", "arguments", "uid"))["uid"].alias("own")), "owners")
    linked = calls.join(owner, keyed, "left").withColumn("leads", F.coalesce(F.col("uid") == F.col("own"), F.lit(False)))
    linked = linked.join(folded.hint("shuffle_hash"), keyed, "left")

    references = calls.select("conv_id", "uid", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), 1))).alias("call_id"))
    found = stage(references.join(owner, keyed, "left"), "references")
    missing = found.where("own is null").groupBy("uid").agg(F.sort_array(F.collect_list(F.concat(F.lit("$: refers to no call "), "call_id"))).alias("missing"))
    level = _levels(found.where("own is not null").select("conv_id", "uid", F.col("own").alias("ref")), stage, most)
    linked = linked.join(missing, "uid", "left").join(level, "uid", "left").withColumn("checked", _checked(tools))

    none = F.array().cast("array<string>")
    extra = F.when(F.col("call_id").isNull(), F.array(F.lit("$: no identifier"))).when(~F.col("leads"), F.array(F.lit("$: identifier used before"))).otherwise(none)
    return linked.select(
        "conv_id",
        "turn",
        "call_id",
        "name",
        F.when(F.col("leads"), F.col("first.turn")).alias("result_turn"),
        F.when(F.col("leads"), F.col("first.content")).alias("content"),
        F.when(F.col("leads"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_results"),
        F.coalesce("level", F.lit(0)).cast("long").alias("level"),
        F.concat(F.coalesce("checked.errors", none), extra, F.coalesce("missing", none)).alias("errors"),
        F.col("checked.canonical").alias("canonical"),
    )


_AFTER = {"type": "string"}
#: The tools of plain conversations, see turns_as_calls().
TOOLS = {
    "reply": {
        "type": "object",
        "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}, "tone": {"enum": ["plain", "warm"]}, "after": _AFTER},
        "required": ["text", "turn"],
        "additionalProperties": False,
    },
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}, "after": _AFTER},
        "required": ["query"],
        "additionalProperties": False,
    },
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text), good ones and faulty ones.

    A user's turn is a call with the identifier c<turn>; an assistant's or tool's turn
    is the result of the turn before it.  What is called, and with what, follows
    from p = (code points of the text + turn) mod 12:

    - p mod 3 = 1: ``search`` with the limit 10 p (too large from 7 on), at p = 10 with a page, which isn't allowed;
      p = 11: ``browse``, which no schema knows; otherwise ``reply``, at p = 3 without its text, at p = 5 in a tone that isn't allowed.
    - it refers to the call two turns on where p mod 4 = 2, otherwise to the one two turns back, if the turn is 2 or later;
      so there are references forward, cycles, and references to calls that don't exist.
    - at p = 8 the last brace is missing, so the arguments aren't JSON.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.col("text").alias("content"))
    rows = rows.withColumn("p", (F.length("text") + F.col("turn")) % 12)
    turn, p = F.col("turn"), F.col("p")
    name = F.when(p % 3 == 1, "search").when(p == 11, "browse").otherwise("reply")
    after = F.when(p % 4 == 2, turn + 2).when(turn >= 2, turn - 2)
    after = F.concat(F.lit("$ref:c"), after.cast("string")).alias("after")
    search = F.to_json(F.struct(F.col("text").alias("query"), (10 * p).alias("limit"), F.when(p == 10, 1).alias("page"), after))
    reply = F.to_json(F.struct(F.when(p != 3, F.col("text")).alias("text"), "turn", F.when(p == 5, "loud").alias("tone"), after))
    arguments = F.when(p == 8, F.expr("left(arguments, length(arguments) - 1)")).otherwise(F.col("arguments"))
    calls = rows.where("role = 'user'").withColumn("arguments", F.when(p % 3 == 1, search).otherwise(reply))
    calls = calls.select("conv_id", "turn", F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = rows.where("role in ('assistant', 'tool')").select("conv_id", "turn", F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"), "content")
    return calls, results

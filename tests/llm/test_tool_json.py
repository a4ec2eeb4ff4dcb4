"""Arguments of tool calls that are odd JSON, and schemas that ask for more than is checked."""

import json

import pytest

from peaklight.llm import toolcalls

DEEP = toolcalls.DEEP
SCHEMA = {"type": "object", "properties": {"n": {"type": "integer"}, "e": {"enum": [1, "a", None, [1.0]]}, "x": {"type": "number", "maximum": 5}, "b": {"type": "boolean"}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("text", "canonical", "errors"),
    [
        ("[" * 200_000 + "]" * 200_000, None, ["$: nested too deeply"]),
        ('{"a":' * (DEEP + 1) + "1" + "}" * (DEEP + 1), None, ["$: nested too deeply"]),
        (r'{"x":"\ud800"}', r'"x":"\ud800"', ["$.x: not of type number"]),
        (r'{"\udc00":1}', r'"\udc00":1', [r"$.\udc00: not allowed"]),
        (r'{"x":"😀"}', '"x":"😀"', ["$.x: not of type number"]),
        ('{"x":NaN}', None, ["$: not JSON"]),
        ('{"x":-Infinity}', None, ["$: not JSON"]),
        ('{"x":1e999}', None, ["$: number out of range"]),
        ('{"x":' + "9" * 5000 + "}", None, ["$: number out of range"]),
        ('{"x":-' + "9" * 400 + "}", '"x":-' + "9" * 400, []),
        ('{"n":1.0}', '"n":1', []),
        ('{"n":1.5}', '"n":1.5', ["$.n: not of type integer"]),
        ('{"n":true}', '"n":true', ["$.n: not of type integer"]),
        ('{"e":true}', '"e":true', ["$.e: not in enum"]),
        ('{"e":1.0}', '"e":1', []),
        ('{"e":[1]}', '"e":[1]', []),
        ('{"b":1}', '"b":1', ["$.b: not of type boolean"]),
        ('{"x":9,"x":2}', '"x":2', []),
        ("", None, ["$: not JSON"]),
        (None, None, ["$: not JSON"]),
        ("7 8", None, ["$: not JSON"]),
    ],
)
def test_odd_json(text, canonical, errors):
    value, wrong = toolcalls.read_arguments(text)
    if canonical is None:
        assert (value, [wrong]) == (None, errors)
        return
    assert wrong is None and [toolcalls._shown(e) for e in toolcalls.schema_errors(value, SCHEMA)] == errors
    written = toolcalls.canonical(value)
    assert written == "{" + canonical + "}" and written.encode() and json.loads(written) == value


def test_the_deepest_arguments_that_count():
    for text in ("[" * DEEP + "]" * DEEP, '{"a":' * DEEP + "1" + "}" * DEEP, "[" * (DEEP - 1) + "[],[]" + "]" * (DEEP - 1)):
        value, wrong = toolcalls.read_arguments(text)
        assert wrong is None and toolcalls.canonical(value) == text and toolcalls.schema_errors(value, {}) == []
    assert toolcalls.read_arguments("[" * (DEEP + 1) + "]" * (DEEP + 1)) == (None, "$: nested too deeply")


def test_odd_json_in_a_job(spark):
    texts = ["[" * 200_000 + "]" * 200_000, r'{"x":"\ud800"}', '{"x":NaN}', '{"x":1e999}', "{}"]
    calls = spark.createDataFrame([("c", i, f"i{i}", "t", t) for i, t in enumerate(texts)], "conv_id string, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id string, turn long, call_id string, content string")
    rows = {r.turn: (r.canonical, list(r.errors)) for r in toolcalls.link_tool_calls(calls, results, {"t": {}}).collect()}
    assert rows == {0: (None, ["$: nested too deeply"]), 1: (r'{"arguments":{"x":"\ud800"},"id":"i1","name":"t"}', []), 2: (None, ["$: not JSON"]), 3: (None, ["$: number out of range"]), 4: ('{"arguments":{},"id":"i4","name":"t"}', [])}


@pytest.mark.parametrize("schema", [{"pattern": "a"}, {"properties": {"a": {"$ref": "#"}}}, {"items": {"oneOf": []}}, {"items": [{}]}, {"type": "text"}, {"type": ["string", "date"]}, {"additionalProperties": {}}])
def test_schemas_that_ask_for_more_are_refused(spark, schema):
    calls = spark.createDataFrame([], "conv_id string, turn long, call_id string, name string, arguments string")
    with pytest.raises(ValueError):
        toolcalls.link_tool_calls(calls, calls.selectExpr("conv_id", "turn", "call_id", "name as content"), {"t": schema})
    toolcalls.check_schema({"type": ["string", "null"], "description": "x", "items": {"enum": [1]}})

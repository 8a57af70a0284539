import json
import random
from collections import Counter

import pytest

from vellumite.llm.tool_calls import canonical, check_schema, link_tool_calls, violations

SCHEMA = "conv_id long, turn long, role string, text string, id string, key string, level int, idx int"


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a if isinstance(a, str) else json.dumps(a), "after": after} for i, n, a, after in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


TOOLS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "number"}}, "additionalProperties": False}}
ROWS = [
    (1, 0, "user", "add 1 and 2"), (1, 1, "assistant", call(("x", "add", {"b": 2.0, "a": 1}, []), ("y", "add", {"a": "no"}, ["x"]))), (1, 2, "tool", result("x", "3")), (1, 3, "tool", result("z", "nobody asked")),
    (2, 0, "assistant", call(("p", "add", {"a": 1, "b": 1}, ["q"]), ("q", "other", {}, []))), (2, 1, "tool", result("q", "é \"quoted\"")), (2, 2, "assistant", call(("r", "add", "not json", ["p"]))),
    (3, 0, "assistant", call(("m", "add", {"a": 1, "b": 1}, ["n"]), ("n", "add", {"a": 1, "b": 1, "c": 0}, ["m"]), ("o", "add", {"a": 1, "b": 2}, []))),
    (4, 0, "assistant", call(("s", "add", {"a": 1, "b": 1}, []))), (4, 1, "tool", result("s", "first")), (4, 2, "assistant", call(("s", "add", {"a": 2, "b": 2}, []))), (4, 3, "tool", result("s", "second")),
    (5, 0, "assistant", "{broken"), (5, 1, "tool", None), (5, None, "user", "no turn"), (None, 0, "user", "no conversation"), (6, 0, None, ""), (6, 0, None, ""), (6, 1, "assistant", "{\"other\": 1}"),
]


@pytest.fixture(scope="module")
def linked(spark):
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in ROWS], SCHEMA)
    return link_tool_calls(df, TOOLS).collect()


def test_links_and_values(linked):
    by = {(r.conv_id, r.call_id, r.turn): r for r in linked if r.call_id}
    assert by[1, "x", 1].status == "linked" and by[1, "x", 1].json == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","result":"3"}' and by[1, "x", 1].violations == []
    assert by[1, "y", 1].status == "unanswered" and by[1, "y", 1].violations == ["$.b: missing", "$.a: not number"]
    assert by[1, "z", 3].status == "orphan" and by[1, "z", 3].json == '{"content":"nobody asked","role":"tool","tool_call_id":"z"}'
    assert by[2, "q", 0].violations is None and json.loads(by[2, "q", 0].json)["result"] == 'é "quoted"'
    assert by[2, "r", 2].violations == ["$: not an object"]
    assert by[3, "n", 0].violations == ["$.c: unknown"]
    assert json.loads(by[4, "s", 0].json)["result"] == "first" and json.loads(by[4, "s", 2].json)["result"] == "second"


def test_order(linked):
    level = {(r.conv_id, r.call_id): r.level for r in linked if r.kind == "call" and r.conv_id in (1, 2, 3)}
    assert level == {(1, "x"): None, (1, "y"): None, (2, "q"): 0, (2, "p"): 1, (2, "r"): 2, (3, "o"): 0, (3, "m"): -1, (3, "n"): -1}


def test_every_row_is_kept(linked):
    kinds = Counter(r.kind for r in linked)
    assert kinds == {"call": 10, "result": 1, "message": 8}
    assert sorted(r.json for r in linked if r.conv_id == 6) == ['{"content":"","role":null}'] * 2 + ['{"content":"{\\"other\\": 1}","role":"assistant"}']


def test_a_long_chain_backwards(spark):
    n = 12
    rows = [(1, k, "assistant", call((f"c{k}", "t", {}, [f"c{k + 1}"] if k + 1 < n else []))) for k in range(n)]
    got = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.level for r in got} == {k: n - 1 - k for k in range(n)}


def test_random_graphs_match_brute_force(spark):
    rng, rows, expected = random.Random(4), [], {}
    for conv in range(12):
        n = rng.randint(2, 14)
        after = {k: rng.sample(range(n), rng.choice([0, 1, 1, 1, 2, 3]) if n > 3 else 1) for k in range(n)}
        rows += [(conv, k, "assistant", call((f"c{k}", "t", {}, [f"c{x}" for x in after[k]]))) for k in range(n)]
        level = {}
        while free := [k for k in after if k not in level and all(x in level for x in after[k])]:
            level |= {k: max((level[x] + 1 for x in after[k]), default=0) for k in free}
        moved = any(x >= k for k in after for x in after[k])
        expected |= {(conv, k): level.get(k, -1) if moved else None for k in after}
    got = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.level for r in got} == expected


def test_empty_table(spark):
    assert link_tool_calls(spark.createDataFrame([], SCHEMA), TOOLS).collect() == []


def test_canonical_json():
    assert canonical({"b": [1.0, 1.5, float("nan")], "a": {"é": None, "x": True}}) == '{"a":{"x":true,"é":null},"b":[1,1.5,null]}'


def test_schemas():
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"type": ["string", "null"], "maxLength": 2}, "l": {"type": "array", "items": {"enum": ["a"]}}}}
    assert violations({"n": 2.0, "s": None, "l": ["a"]}, schema) == []
    assert violations({"n": 0, "s": "abc", "l": ["b"]}, schema) == ["$.l[0]: not in enum", "$.n: minimum", "$.s: maxLength"]
    assert violations({"n": True}, schema) == ["$.n: not integer"] and violations([], schema) == ["$: not object"]


def test_messages_beside_calls_and_calls_without_id(spark):
    one = {"id": "a", "name": "add", "arguments": "{}", "after": []}
    texts = [
        {"content": "I look it up", "tool_calls": [one]}, {"content": "none needed", "tool_calls": []}, {"tool_calls": []}, {"content": None, "tool_calls": [one | {"id": "b"}]},
        {"tool_calls": [{"name": "add", "arguments": "{}"}, one | {"id": "c"}], "refusal": {"why": [1]}}, {"tool_calls": [{"name": "add"}, {"name": "other"}]},
    ]
    rows = [(1, k, "assistant", json.dumps(t)) for k, t in enumerate(texts)]
    got = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = sorted((r.turn, r.idx, r.call_id or "", r.status) for r in got if r.kind == "call")
    assert calls == [(0, 0, "a", "unanswered"), (3, 0, "b", "unanswered"), (4, 0, "", "unanswered"), (4, 1, "c", "unanswered"), (5, 0, "", "unanswered"), (5, 1, "", "unanswered")]
    told = {(r.turn, r.idx): json.loads(r.json) for r in got if r.kind == "message"}
    assert told == {
        (0, -1): {"role": "assistant", "content": "I look it up"}, (1, 0): {"role": "assistant", "content": rows[1][3]}, (2, 0): {"role": "assistant", "content": rows[2][3]},
        (4, -1): {"role": "assistant", "refusal": {"why": [1]}},
    }
    assert len(got) == len(calls) + len(told)


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"exclusiveMinimum": 1}, 2, 1), ({"exclusiveMaximum": 1}, 0, 1), ({"multipleOf": 0.1}, 0.3, 0.35), ({"minItems": 1}, [1], []), ({"maxItems": 1}, [1], [1, 2]),
        ({"uniqueItems": True}, [1, True], [1, 1.0]), ({"additionalProperties": {"type": "string"}}, {"a": "b"}, {"a": 1}), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 4, 2),
        ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, 4), ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, 2, 4), ({"not": {"const": 1}}, True, 1), ({"items": False}, [], [1]), ({"enum": [1]}, 1.0, True),
    ],
)
def test_more_keywords(schema, good, bad):
    assert violations(good, schema) == [] and violations(bad, schema)


@pytest.mark.parametrize("schema", [{"pattern": "a"}, {"properties": {"a": {"$ref": "#"}}}, {"anyOf": [{"if": {}}]}, {"additionalProperties": {"patternProperties": {}}}])
def test_unknown_keywords_raise(spark, schema):
    with pytest.raises(ValueError, match="not supported"):
        link_tool_calls(spark.createDataFrame([], SCHEMA), {"t": schema})


def test_arguments_that_are_hard_to_read(spark):
    """Half a surrogate pair, numbers of 400 digits and beyond a double, deep nesting: rows like all others."""
    tools = {"f": {"type": "object", "properties": {"x": {"type": "integer", "multipleOf": 3}, "y": {"type": "number", "multipleOf": 0.01}}, "additionalProperties": {"type": "string", "maxLength": 1}}}
    arguments = [
        '{"s":"\\ud800"}', '{"\\udc00":"long"}', '{"x":' + "3" * 400 + "}", '{"x":' + "3" * 399 + "4}", '{"x":' + "3" * 5000 + "}", '{"y":1e40}', '{"y":1e999}', '{"y":-1e400,"x":1e40}', '{"y":0.07}', '{"y":0.075}',
        '{"z":' + "[" * 200_000 + "]" * 200_000 + "}", "[" * 200_000, '{"x":1.0}', '{"x":NaN}',
    ]
    rows = [(k, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": a}]})) for k, a in enumerate(arguments)]
    found = {r.conv_id: r for r in link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).collect()}
    assert len(found) == len(rows)
    assert [len(found[k].violations) for k in range(len(rows))] == [0, 1, 0, 1, 1, 0, 1, 2, 0, 1, 1, 1, 1, 1]
    assert json.loads(found[0].json)["arguments"] == {"s": "\ud800"} and json.loads(found[2].json)["arguments"]["x"] == int("3" * 400)
    assert json.loads(found[10].json)["arguments"] == arguments[10] and found[1].violations == ["$.\\udc00: maxLength"]


@pytest.mark.parametrize("schema", [{"multipleOf": 0}, {"multipleOf": -1}, {"minimum": "1"}, {"maximum": float("inf")}, {"minLength": None}])
def test_bounds_that_make_no_sense(schema):
    with pytest.raises(ValueError):
        check_schema(schema)

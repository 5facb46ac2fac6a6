import json

from drayage.llm import queries, tool_calls
from drayage.llm.tool_calls import canonical, errors
from tests.conftest import DATA
from tests.parity import differences, duck


def test_canonical_json():
    assert canonical({"b": 1.0, "a": [True, None, 0.1, 1e21, 1e-7, 0.000001], "é\n": " \"\\"}) == (
        '{"a":[true,null,0.1,1e+21,1e-7,0.000001],"b":1,"é\\n":" \\"\\\\"}'
    )
    assert canonical({"דּ": 1, "\U0001f600": 2}) == '{"\U0001f600":2,"דּ":1}'  # by UTF-16 units
    assert canonical(float("nan")) == "null" and canonical(-0.0) == "0"


def test_schema_errors():
    schema = {
        "type": "object",
        "required": ["a"],
        "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}}, "c": {"type": "string", "maxLength": 2}},
    }
    assert errors({"a": 1, "b": ["x"], "c": "yy"}, schema) == []
    assert errors({"a": 0, "b": ["x", "y"], "c": "yyy", "d": 1}, schema) == [
        "$.a: out of range", "$.b[1]: not one of the allowed values", "$.c: too long", "$.d: unknown",
    ]
    assert errors({"b": []}, schema) == ["$.a: missing"] and errors(True, {"type": "integer"}) == ["$: not integer"]


CALLS = "id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "id string, turn long, content string"


def test_links_levels_and_statuses(spark):
    calls = [
        ("a", 1, "f", '{"x": 1}', None), ("b", 2, "f", '{"x": "no"}', ["a"]), ("c", 3, "f", "{broken", ["b", "a", "gone"]), ("d", 4, "g", "{}", ["c", None]),
        ("x", 5, "f", '{"x": 2}', ["y"]), ("y", 6, "f", '{"x": 2}', ["x"]), ("z", 7, "f", '{"x": 2}', ["y"]),
        ("a", 1, "f", '{"x": 1}', None), ("b", 9, "f", '{"x": 5}', None), (None, 8, "f", '{"x": 3}', None), ("n", None, None, None, None),
    ]
    results = [("a", 2, "ra"), ("a", 2, "ra"), ("b", 3, "second"), ("b", 3, "first"), ("o", 4, "orphan"), (None, 1, None), ("c", None, None)]
    got = tool_calls.link(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS),
        {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}},
    ).collect()
    found = {(r.id, r.status, r.call_turn): r for r in got}
    assert len(found) == len(got) == 13
    assert {r.id: r.level for r in got if r.status in ("linked", "open")} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": -1, "y": -1, "z": -1, "n": 0}
    assert {r.id: r.status for r in got if r.level is not None} == {"a": "linked", "b": "linked", "c": "linked", "d": "open", "x": "open", "y": "open", "z": "open", "n": "open"}
    a = found["a", "linked", 1]
    assert a.copies == 2 and a.valid and a.json == '{"arguments":{"x":1},"id":"a","name":"f","result":"ra","status":"linked"}'
    b = found["b", "linked", 2]
    assert not b.valid and b.errors == "$.x: not integer" and json.loads(b.json)["result"] == "first"
    assert found["c", "linked", 3].errors == "$: not JSON" and found["d", "open", 4].errors == "$: unknown name"
    assert sorted(r.status for r in got if r.level is None) == ["conflict", "conflict", "orphan", "unnamed", "unnamed"]


def test_needs_that_name_no_call_are_errors(spark):
    calls = [
        ("a", 1, "f", "{}", ["gone", "b", "away"]), ("b", 2, "f", "{}", None), ("a", 3, "f", "{}", ["b", "lost"]),
        (None, 4, "f", "{}", ["none"]), ("d", 5, "f", "{}", ["a", None]),
    ]
    got = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).collect()
    assert {(r.id, r.call_turn): (r.status, r.valid, r.errors, r.level) for r in got} == {
        ("a", 1): ("open", False, "needs: no call away; needs: no call gone", 1),
        ("b", 2): ("open", True, "", 0),
        ("a", 3): ("conflict", False, "needs: no call lost", None),
        (None, 4): ("unnamed", False, "needs: no call none", None),
        ("d", 5): ("open", True, "", 2),
    } and len(got) == 5


def test_long_chains_and_empty_tables(spark):
    calls = [(f"c{i}", i, "f", "{}", [f"c{i - 1}"] if i else None) for i in range(6)]
    frame = spark.createDataFrame(calls, CALLS)
    none = spark.createDataFrame([], RESULTS)
    assert {r.id: r.level for r in tool_calls.link(frame, none, {"f": {}}).collect()} == {f"c{i}": i for i in range(6)}
    assert tool_calls.link(frame.limit(0), none, {}).isEmpty()


def test_query_matches_sql(spark):
    assert differences(queries.op7_tool_calls(spark, DATA), duck(DATA), queries.oracle_sql()["op7_tool_calls"]) == []


def test_odd_conversations(spark):
    rows = [(1, 0, "system", ""), (1, 1, "user", None), (1, 2, None, "x"), (None, 0, "user", "y"), (2, None, "tool", "z"), (1, 1, "user", None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' AS id", "1 AS level")
    calls, results = tool_calls.conversation_calls(messages)
    got = {(r.id, r.status): (r.valid, r.copies, r.level) for r in tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()}
    assert got == {("1:0", "open"): (False, 1, 0), ("1:1", "linked"): (False, 2, 1), (None, "unnamed"): (True, 1, None)}


def test_hostile_arguments(spark):
    deep, long = "[" * 100_000, "1" * 5000
    arguments = {
        "deep": deep, "closed": deep + "]" * 100_000, "deeper": "[" * 3000 + "]" * 3000, "alone": '"\\ud800"', "key": '{"\\udc00":1}',
        "long": long, "pair": '"\\ud83d\\ude00"', "fits": "1" * 4000,
    }
    calls = [(name, i, "f", text, None) for i, (name, text) in enumerate(arguments.items())]
    got = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).collect()
    found = {r.id: r for r in got}
    assert {n: r.errors for n, r in found.items() if not r.valid} == {
        "deep": "$: nested too deep", "closed": "$: nested too deep", "long": "$: number too long",
    } | ({"deeper": "$: nested too deep"} if not found["deeper"].valid else {})
    assert json.loads(found["deep"].json)["arguments"] == deep and json.loads(found["long"].json)["arguments"] == long
    assert json.loads(found["alone"].json)["arguments"] == "\ud800" and '"\\ud800"' in found["alone"].json
    assert '{"\\udc00":1}' in found["key"].json
    assert json.loads(found["pair"].json)["arguments"] == "\U0001f600" and json.loads(found["fits"].json)["arguments"] == int("1" * 4000)

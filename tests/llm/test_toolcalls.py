import json
import random

import pytest

from verdant.llm import canonical as C
from verdant.llm import toolcalls

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, schemas=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r.asDict() for r in toolcalls.link_tool_calls(df, schemas).orderBy("conv_id", "level", "turn", "call_id").collect()]


def test_plain_messages(spark):
    got = run(spark, [(1, 0, "system", "be brief"), (1, 1, "user", 'say "é"\n'), (1, 2, "assistant", "é"), (1, 3, "user", ""), (2, 0, "user", "hi")])
    assert [(r["call_id"], r["level"], r["valid"], r["result_turn"]) for r in got] == [("1-0", 0, True, None), ("1-1", 1, True, 2), ("1-3", 2, False, None), ("2-0", 0, True, None)]
    assert got[1]["json"] == '{"after":"1-0","arguments":{"text":"say \\"é\\"\\n"},"id":"1-1","name":"message","result":"é"}'
    assert got[2]["errors"] == "$.text: length out of bounds"


def test_stated_calls_are_ordered_and_validated(spark):
    schemas = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "l": {"type": "array", "items": {"enum": ["x"]}}}, "additionalProperties": False}}
    calls = [{"id": "c", "after": "b", "name": "add", "arguments": {"a": 1}}, {"id": "b", "after": "a", "name": "add", "arguments": '{"a": -1, "z": 0, "l": ["y"]}'}, {"id": "a", "name": "sub", "arguments": "{"}, {"id": "p", "after": "q", "name": "add", "arguments": {"a": 2.0}}, {"id": "q", "after": "p", "name": "add", "arguments": {"a": True}}]
    rows = [(5, 0, "assistant", json.dumps({"tool_calls": calls})), (5, 1, "tool", json.dumps({"tool_call_id": "c", "content": {"b": 1, "a": 2}})), (5, 2, "assistant", json.dumps({"tool_calls": [calls[0]]}))]
    got = {(r["call_id"], r["turn"]): r for r in run(spark, rows, schemas)}
    assert {k: r["level"] for k, r in got.items()} == {("a", 0): 0, ("b", 0): 1, ("c", 0): 2, ("c", 2): 2, ("p", 0): None, ("q", 0): None}
    assert got["c", 0]["valid"] and got["c", 0]["json"] == '{"after":"b","arguments":{"a":1},"id":"c","name":"add","result":"{\\"a\\":2,\\"b\\":1}"}'
    assert got["c", 2]["errors"] == "a repeated id; answered before it was made"
    assert got["b", 0]["errors"] == "$.a: out of bounds; $.l[0]: not one of the values allowed; $.z: unknown"
    assert got["a", 0]["errors"] == "arguments aren't JSON; no schema" and got["q", 0]["errors"] == "a cycle; $.a: not integer" and got["p", 0]["errors"] == "a cycle"


def test_levels_of_long_chains(spark):
    rng = random.Random(1)
    parents = {i: rng.choice([None, *range(max(0, i - 3), i)]) if i % 50 == 0 else rng.randrange(max(0, i - 3), i) for i in range(1, 300)} | {0: None}
    want = {}
    for i in range(300):
        want[str(i)] = 0 if parents[i] is None else want[str(parents[i])] + 1
    rows = [(9, str(i), None if p is None else str(p)) for i, p in parents.items()]
    got = {r["call_id"]: r["level"] for r in toolcalls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after_id string")).collect()}
    assert got == want


def test_nulls_and_empty(spark):
    got = run(spark, [(None, 0, "user", "a"), (None, 1, None, "b"), (1, None, "user", None), (1, None, "user", None), (2, 0, "user", '{"tool_calls": [null, {"id": null}]}')])
    assert len(got) == 5 and sum(r["errors"].startswith("no id") for r in got) == 2
    assert run(spark, []) == []
    extra = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], SCHEMA + ", json string, level string")
    assert toolcalls.link_tool_calls(extra).count() == 1


def test_broken_and_long_texts_give_error_rows(spark):
    schemas = {"f": {"type": "object", "properties": {"n": {"type": "integer"}, "x": {"type": "number"}}}}
    call = lambda k, body: {"id": k, "name": "f", "arguments": body}
    deep = "[" * 100_000 + "]" * 100_000
    object_ = '{"a":' * 50_000 + "1" + "}" * 50_000
    calls = [call("a", '{"n": NaN}'), call("b", '{"x": 1e999}'), call("c", '{"n": 1e3}'), call("d", deep), call("e", '{"z": ' + "[" * 300 + "]" * 300 + "}"), call("f", "-Infinity"), call("g", '{"n": ' + "9" * 5000 + "}"), call("h", '{"\\ud800": "\\udc00x"}'), call("i", {"x": "y" * 300_000}), call("j", object_)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), (2, 0, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"f","arguments":"{}"}]}'), (3, 0, "user", '{"tool_calls": NaN}'), (4, 0, "user", "{" * 50_000), (5, 0, "user", deep), (6, 0, "user", "w " * 500_000)]
    got = {(r["conv_id"], r["call_id"]): r for r in run(spark, rows, schemas)}
    bad = "arguments aren't JSON; $: not object"
    assert {k: r["errors"] for (c, k), r in got.items() if c == 1} == {"a": bad, "b": bad, "c": "", "d": "$: not object", "e": "", "f": bad, "g": bad, "h": "", "i": "$.x: not number", "j": ""}
    assert got[2, "\ufffd"]["valid"] and got[3, "3-0"]["name"] == "message" and len(got[6, "6-0"]["json"]) > 1_000_000 and len(got) == 15
    assert f'"arguments":{object_},' in got[1, "j"]["json"] and f'"arguments":{deep},' in got[1, "d"]["json"]
    for r in got.values():
        toolcalls.loads(r["json"])
    assert json.loads(got[1, "h"]["json"])["arguments"] == {"\ufffd": "\ufffdx"}


def test_deep_arguments_take_no_other_call_along(spark):
    """Arguments as JSON itself, not as text: 50,000 levels in an object among good calls of one message."""
    deep = '{"a":' * 50_000 + "[]" + "}" * 50_000
    text = f'{{"tool_calls":[{{"id":"a","name":"f","arguments":{{"n":1}}}},{{"id":"b","after":"a","name":"f","arguments":{deep}}},{{"id":"c","name":"f","arguments":{{"n":true}}}}]}}'
    schemas = {"f": {"type": "object", "properties": {"n": {"enum": [1]}}}}
    got = {r["call_id"]: r for r in run(spark, [(1, 0, "assistant", text), (1, 1, "tool", '{"tool_call_id":"a","content":2.0}')], schemas)}
    assert {k: (r["level"], r["errors"]) for k, r in got.items()} == {"a": (0, ""), "b": (1, ""), "c": (0, "$.n: not one of the values allowed")}
    assert got["a"]["json"] == '{"after":null,"arguments":{"n":1},"id":"a","name":"f","result":"2"}' and deep in got["b"]["json"]


def test_deep_and_flat_readers_agree():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        return [None, True, rng.randrange(-10**6, 10**6), rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30), "".join(rng.choice('ab"\\\n é😀') for _ in range(5))][kind] if kind < 5 else [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {str(rng.randrange(50)): value(depth - 1) for _ in range(rng.randrange(4))}

    for _ in range(300):
        x = value(4)
        text = json.dumps(x, indent=rng.choice([None, 1]))
        assert C._deep(text) == C.loads(text) == x and C.canonical(x) == C.canonical(C.loads(C.canonical(x)))
        cut = text[: rng.randrange(len(text) + 1)] + rng.choice(["", "]", "}", ",", "x"])
        outcomes = []
        for read in (C._deep, C.loads):
            try:
                outcomes.append(read(cut))
            except ValueError:
                outcomes.append(ValueError)
        assert outcomes[0] == outcomes[1], cut


NUMBERS = {0.0: "0", -0.0: "0", 2.0: "2", 2: "2", -1.5: "-1.5", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 333333333.33333329: "333333333.3333333", 1e30: "1e+30", 4.5: "4.5", 0.002: "0.002", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 123456789012345680000: "123456789012345680000", 9007199254740993: "9007199254740992", 1.5e-9: "1.5e-9"}


@pytest.mark.parametrize("value", list(NUMBERS))
def test_canonical_numbers(value):
    assert C.number(value) == NUMBERS[value]


def test_members_are_in_the_order_of_utf16_units():
    assert C.canonical({"\ufb33": 1, "😀": 2, "é": 3, "a": 4}) == '{"a":4,"é":3,"😀":2,"\ufb33":1}'


def test_keywords():
    bad = lambda v, **s: toolcalls.violations(v, s)
    assert bad("ab", pattern="^a") == [] and bad("b", pattern="^a") and bad(1, const=1.0) == [] and bad(True, const=1) and bad(0, exclusiveMinimum=0) and bad(0.3, multipleOf=0.1) and bad(3, multipleOf=1.5) == []
    assert bad([1, 1.0], uniqueItems=True) and bad([1, True], uniqueItems=True) == [] and bad([], minItems=1) and bad({"a": 1}, maxProperties=0)
    assert bad(1, oneOf=[{"type": "integer"}, {"minimum": 0}]) and bad(-1, oneOf=[{"type": "integer"}, {"minimum": 0}]) == [] and bad("x", anyOf=[{"type": "null"}]) and bad(1, **{"not": {"type": "integer"}}) and bad(1, allOf=[{"minimum": 2}])
    assert bad({"a": 1, "b": "x"}, properties={"a": True}, additionalProperties={"type": "integer"}) == ["$.b: not integer"] and bad({"a": 1}, properties={"a": False}) == ["$.a: forbidden"]
    assert bad(1, format="date") == ["$: the schema's 'format' isn't known"] and bad(1, description="a number") == [] and bad(1, type="whole") == ["$: not whole"]

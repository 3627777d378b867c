"""Tool-call linking for chat data.

Calls and results are hash-joined by conversation and identifier. A call may
name another that it comes after; levels of these chains are found by pointer
doubling, in as many rounds as the logarithm of the longest chain. Arguments
are validated against JSON schemas and each call is serialised with its result
as canonical JSON (RFC 8785). Texts of any depth are read.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.canonical import canonical, loads, whole
from verdant.llm.shared import map_arrow, written

#: Schemas of the functions that plain messages stand for.
SCHEMAS = {
    "message": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Keywords that describe and forbid nothing.
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}


def _is_type(value, name: str) -> bool:
    if name in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (name == "number" or isinstance(value, int) or value.is_integer())
    return name in _TYPES and isinstance(value, _TYPES[name])


def _among(value, allowed: list) -> bool:
    """Whether JSON values are equal: true isn't 1, 1.0 is."""
    own = canonical(value)
    return any(canonical(x) == own for x in allowed)


def _distinct(values: list) -> bool:
    return len({canonical(x) for x in values}) == len(values)


def _is_number(value) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


#: What a keyword demands of a value: whose business it is, whether a value is good, and what is told of one that isn't.
_RULES = {
    "enum": (lambda v: True, _among, "not one of the values allowed"),
    "const": (lambda v: True, lambda v, x: _among(v, [x]), "not the value allowed"),
    "minLength": (lambda v: isinstance(v, str), lambda v, x: len(v) >= x, "length out of bounds"),
    "maxLength": (lambda v: isinstance(v, str), lambda v, x: len(v) <= x, "length out of bounds"),
    "pattern": (lambda v: isinstance(v, str), lambda v, x: re.search(x, v) is not None, "not of the pattern"),
    "minimum": (_is_number, lambda v, x: v >= x, "out of bounds"),
    "maximum": (_is_number, lambda v, x: v <= x, "out of bounds"),
    "exclusiveMinimum": (_is_number, lambda v, x: v > x, "out of bounds"),
    "exclusiveMaximum": (_is_number, lambda v, x: v < x, "out of bounds"),
    "multipleOf": (_is_number, lambda v, x: Fraction(v) % Fraction(str(x)) == 0, "not a multiple"),
    "minItems": (lambda v: isinstance(v, list), lambda v, x: len(v) >= x, "number of items out of bounds"),
    "maxItems": (lambda v: isinstance(v, list), lambda v, x: len(v) <= x, "number of items out of bounds"),
    "uniqueItems": (lambda v: isinstance(v, list), lambda v, x: not x or _distinct(v), "repeated items"),
    "minProperties": (lambda v: isinstance(v, dict), lambda v, x: len(v) >= x, "number of members out of bounds"),
    "maxProperties": (lambda v: isinstance(v, dict), lambda v, x: len(v) <= x, "number of members out of bounds"),
    "anyOf": (lambda v: True, lambda v, x: any(not violations(v, s) for s in x), "none of the schemas allowed"),
    "oneOf": (lambda v: True, lambda v, x: sum(not violations(v, s) for s in x) == 1, "not of exactly one of the schemas allowed"),
    "not": (lambda v: True, lambda v, x: bool(violations(v, x)), "of a schema forbidden"),
}
_KNOWN = {*_RULES, *_NOTES, "type", "required", "properties", "additionalProperties", "items", "allOf"}


def violations(value, schema: dict | bool, path: str = "$") -> list[str]:
    """What in ``value`` a schema forbids; a keyword that isn't known here is an error of the schema, as what it forbids would pass."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: forbidden"]
    out = [f"{path}: the schema's {k!r} isn't known" for k in sorted(schema.keys() - _KNOWN)]
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is_type(value, n) for n in names):
            return [*out, f"{path}: not {' or '.join(names)}"]
    told = [what for k, (concerns, good, what) in _RULES.items() if k in schema and concerns(value) and not good(value, schema[k])]
    out += [f"{path}: {what}" for what in dict.fromkeys(told)]
    for part in schema.get("allOf", []):
        out += violations(value, part, path)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        other = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif other is False:
                out.append(f"{path}.{k}: unknown")
            else:
                out += violations(value[k], other, f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


EVENTS = "conv_id long, turn long, kind string, call_id string, after_id string, name string, body string"


def events(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Calls and results (kind) in messages.

    A text that is a JSON object with ``tool_calls`` (a list of id, name,
    arguments and maybe after) is those calls; one with ``tool_call_id`` and
    ``content`` is a result. Any other message of a user or system is a call
    of ``message`` or ``configure`` whose id is the conversation and turn; it
    comes after the call that the turn before it is or answers. Any other message is the result of the call
    in the turn before.
    """

    def rows(columns):
        for conv, turn, role, raw in zip(*columns, strict=True):
            role, text = (role or b"").decode("utf-8", "replace"), None if raw is None else raw.decode("utf-8", "replace")
            own = _object(text)
            if isinstance(own.get("tool_calls"), list):
                for call in own["tool_calls"]:
                    call = call if isinstance(call, dict) else {}
                    yield conv, turn, "call", _text(call.get("id")), _text(call.get("after")), _text(call.get("name")), _text(call.get("arguments"))
            elif "tool_call_id" in own:
                yield conv, turn, "result", _text(own["tool_call_id"]), None, None, _text(own.get("content"))
            elif role in ("user", "system"):
                n = -1 if turn is None else turn
                yield conv, turn, "call", f"{conv}-{turn}", f"{conv}-{n - 2}" if role == "user" and n > 1 else f"{conv}-{n - 1}" if n > 0 else None, "message" if role == "user" else "configure", canonical({"text": text})
            else:
                yield conv, turn, "result", f"{conv}-{(0 if turn is None else turn) - 1}", None, None, text

    return map_arrow(messages.select(F.col(conv_col).cast("long").alias("_c"), F.col(turn_col).cast("long").alias("_n"), F.col(role_col).alias("_r"), F.col(text_col).alias("_t")), ["_c", "_n", "_r", "_t"], EVENTS, rows)


def _object(text: str | None) -> dict:
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        own = loads(text)
    except ValueError:
        return {}
    return own if isinstance(own, dict) else {}


def _text(value) -> str | None:
    return value if value is None else whole(value) if isinstance(value, str) else canonical(value)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls; level counts the calls before one, null in a cycle.

    A call that comes after an unknown one, or after none, has level 0. Of
    repeated ids the least ``after_id`` counts.
    """
    nodes = calls.groupBy("conv_id", "call_id").agg(F.min("after_id").alias("to"))
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"))
    nodes = nodes.join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("to") == F.col("_k")), "left")
    now = written(nodes.select("conv_id", "call_id", F.col("_k").alias("to"), F.when(F.col("_k").isNotNull(), 1).otherwise(0).cast("long").alias("level")), "levels")
    most = now.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(max(1, most).bit_length()):
        if not now.where("to is not null").head(1):
            break
        ahead = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), F.col("to").alias("_to"), F.col("level").alias("_level"))
        on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("to") == F.col("_k"))
        now = written(now.join(ahead, on, "left").select("conv_id", "call_id", F.col("_to").alias("to"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), "levels")
    return now.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


LINKED = "conv_id long, turn long, call_id string, level long, name string, valid boolean, errors string, result_turn long, json string"


def linked(found: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per call: its level, errors, and canonical JSON with its result.

    (conv_id, level, turn, call_id) is a topological order. The earliest
    result of an id counts, and the earliest call of an id is the one that is
    valid; later ones are told as repeated. Errors are joined by "; ".
    """
    schemas = SCHEMAS if schemas is None else schemas
    calls, results = found.where("kind = 'call'"), found.where("kind = 'result'")
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("at"), "turn", "body")).alias("r"))
    answer = answer.select(F.col("conv_id").alias("_rc"), F.col("call_id").alias("_rk"), F.col("r")["turn"].alias("result_turn"), F.col("r")["body"].alias("result"))
    first = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first")).select(F.col("conv_id").alias("_fc"), F.col("call_id").alias("_fk"), "first")
    depth = levels(calls.where("call_id is not null")).select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_lk"), "level")
    same = lambda c, k: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("call_id") == F.col(k))
    rows = calls.join(answer, same("_rc", "_rk"), "left").join(first, same("_fc", "_fk"), "left").join(depth, same("_lc", "_lk"), "left")
    cols = ["conv_id", "turn", "call_id", "after_id", "name", "body", "level", "first", "result_turn", "result"]

    def serialise(columns):
        for conv, turn, call, after, name, body, level, earliest, result_turn, result in zip(*[[x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in c] for c in columns], strict=True):
            errors = []
            if call is None:
                errors.append("no id")
            elif level is None:
                errors.append("a cycle")
            if earliest is not None and turn is not None and turn > earliest:
                errors.append("a repeated id")
            if result_turn is not None and turn is not None and result_turn < turn:
                errors.append("answered before it was made")
            try:
                arguments = loads(body) if body is not None else None
            except ValueError:
                arguments = body
                errors.append("arguments aren't JSON")
            if name not in schemas:
                errors.append("no schema")
            else:
                errors += violations(arguments, schemas[name])
            linked_call = {"after": after, "arguments": arguments, "id": call, "name": name, "result": result}
            yield conv, turn, call, level, name, not errors, whole("; ".join(errors)), result_turn, canonical(linked_call)

    return map_arrow(rows, cols, LINKED, serialise)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``linked`` calls of messages.

    A text that isn't strict JSON (NaN, numbers out of range) is a plain
    message, and such arguments are told as no JSON; half a surrogate pair
    becomes U+FFFD. Texts of any length and depth are read whole.

    Nulls: a null conversation is one of its own; a null turn or role is no
    user's; a null text is an argument or result null. Repeated messages give
    a row each, all but none of them told apart. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    return linked(written(events(messages, conv_col, turn_col, role_col, text_col), "events"), schemas)


def op2_tool_calls(spark, sf_dir: str) -> DataFrame:
    return link_tool_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


STATED = {"count": {"type": "object", "required": ["n", "of"], "properties": {"n": {"type": "integer", "exclusiveMinimum": 0, "maximum": 60}, "of": {"const": "user"}}, "additionalProperties": False}}


def stated_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Calls that messages state, made from the conversations: each turn of a user or system counts its text, and the next turn tells the answer."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role in ('user', 'system')")
    own = F.concat_ws("-", F.lit("c"), "conv_id", "turn")
    before = F.when(F.col("turn") > 0, F.concat_ws("-", F.lit("c"), "conv_id", F.col("turn") - F.when(F.col("role") == "user", 2).otherwise(1)))
    arguments = F.struct(F.length("text").alias("n"), F.col("role").alias("of"))
    call = F.struct(own.alias("id"), before.alias("after"), F.lit("count").alias("name"), arguments.alias("arguments"))
    calls = turns.select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    answer = F.struct(own.alias("tool_call_id"), F.struct(F.size(F.split("text", " ")).alias("words"), F.length("text").alias("characters")).alias("content"))
    results = turns.where(F.length("text") % 3 > 0).select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), F.to_json(answer).alias("text"))
    return link_tool_calls(calls.unionByName(results), STATED)

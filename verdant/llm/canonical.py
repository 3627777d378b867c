"""Strict JSON in and canonical JSON out, at any depth.

The canonical form is that of RFC 8785: members in the order of their names'
UTF-16 units, numbers as the shortest text of their IEEE double, no spaces.
"""

from __future__ import annotations

import json
import math
import re
from json.decoder import scanstring

_HALF = re.compile("[\ud800-\udfff]")
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def whole(text: str) -> str:
    """``text`` with halves of surrogate pairs, which no text can hold, as U+FFFD."""
    return _HALF.sub("�", text)


def _real(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("a number out of range")
    return x


def _whole_number(text: str) -> int:
    _real(text)  # what no double can hold is out of range
    return int(text)


def loads(text: str):
    """The value of strict JSON of any depth; ValueError for anything else and for numbers out of range."""
    try:
        return json.loads(text, parse_constant=_real, parse_float=_real, parse_int=_whole_number)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """``loads`` with a stack of its own in place of Python's."""
    at = _SPACE.match(text, 0).end()
    stack: list[tuple] = []  # (container, its member's name)
    while True:
        c = text[at : at + 1]
        if c in ("{", "[") and c:
            own = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name, at = _name(text, at) if c == "{" else (None, at)
                stack.append((own, name))
                continue
            value, at = own, at + 1
        else:
            value, at = _plain(text, at)
        # A value is complete: put it where it belongs, and all that it completes.
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at < len(text):
                    raise ValueError("more than one value")
                return value
            own, name = stack.pop()
            if isinstance(own, dict):
                own[name] = value
            else:
                own.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                name, at = _name(text, at) if isinstance(own, dict) else (None, at)
                stack.append((own, name))
                break
            if c != ("}" if isinstance(own, dict) else "]"):
                raise ValueError("no end of an object or a list")
            value, at = own, at + 1


def _name(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("no name")
    name, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no value")
    return name, _SPACE.match(text, at + 1).end()


def _plain(text: str, at: int) -> tuple:
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1, True)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError("no value")
    return (_real if m[1] or m[2] else _whole_number)(m[0]), m.end()


def number(value: float) -> str:
    """The shortest decimal of a double, with an exponent from 1e21 on and below 1e-6."""
    value = float(value)
    if value == 0:
        return "0"
    sign, value = ("-", -value) if value < 0 else ("", value)
    mantissa, _, exponent = f"{value!r}e0".split("e")[0], None, int(f"{value!r}e0".split("e")[1])
    before, _, after = mantissa.partition(".")
    after = "" if after == "0" else after
    digits = (before + after).lstrip("0")
    point = len(before) + exponent - (len(before + after) - len(digits))  # of 0.digits, as a power of ten
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    power = point - 1
    return f"{sign}{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{'+' if power > 0 else '-'}{abs(power)}"


def _scalar(value) -> str:
    if isinstance(value, str):
        return json.dumps(whole(value), ensure_ascii=False)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return number(value)


def canonical(value) -> str:
    """Canonical JSON of a value of any depth; of names that become equal when mended the last one stands."""
    out: list[str] = []
    todo: list = [("value", value)]
    while todo:
        kind, x = todo.pop()
        if kind == "text":
            out.append(x)
        elif isinstance(x, dict):
            members = sorted({whole(k): v for k, v in x.items()}.items(), key=lambda m: m[0].encode("utf-16-be"))
            todo.append(("text", "}"))
            for i in range(len(members) - 1, -1, -1):
                todo += [("value", members[i][1]), ("text", f"{',' if i else ''}{_scalar(members[i][0])}:")]
            todo.append(("text", "{"))
        elif isinstance(x, list):
            todo.append(("text", "]"))
            for i in range(len(x) - 1, -1, -1):
                todo += [("value", x[i]), ("text", "," if i else "")]
            todo.append(("text", "["))
        else:
            out.append(_scalar(x))
    return "".join(out)

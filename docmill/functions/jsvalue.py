"""JSON values as ECMAScript sees them: doubles, the last of equal keys, whole-number keys first; of any depth, without recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")
_LONE = re.compile(r"[\ud800-\udfff]")
#: A character that stands for no text: it marks what a UTF-8 text can't hold.
_MARK = "\ufdd0"
_CARRIED = re.compile(f"{_MARK}([0-9a-f]{{4}})")
_WORDS = {"true": True, "false": False, "null": None}


def _number(text: str) -> float:
    return float(text)


def _object(pairs: list[tuple[str, object]]) -> dict:
    """Whole-number keys first, in their order, then the others as they come; the last value of a key counts."""
    out = dict(pairs)
    whole = sorted((k for k in out if len(k) <= 10 and k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
    return {k: out[k] for k in whole} | out if whole else out


def _no(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """The value of a JSON text; bad JSON is a ValueError. Lone surrogates stay in texts as they are."""
    try:
        return json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_no, object_pairs_hook=_object)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """As :func:`parse`, with a list of open values in place of the call stack."""
    open_: list[tuple[bool, list, list]] = []  # whether an object, its values, its keys
    at, value, have = _SPACE.match(text).end(), None, False

    def bad():
        return ValueError(f"bad JSON at character {at}")

    def key(at: int, keys: list) -> int:
        if text[at : at + 1] != '"':
            raise bad()
        name, at = scanstring(text, at + 1)
        keys.append(name)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise bad()
        return _SPACE.match(text, at + 1).end()

    while True:
        if not have:
            c = text[at : at + 1]
            if c in ("[", "{"):
                at = _SPACE.match(text, at + 1).end()
                open_.append((c == "{", [], []))
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    at, have, value = at + 1, True, {} if c == "{" else []
                    open_.pop()
                elif c == "{":
                    at = key(at, open_[-1][2])
                continue
            if c == '"':
                value, at = scanstring(text, at + 1)
            else:
                m = _SCALAR.match(text, at)
                if not m:
                    raise bad()
                value, at = _WORDS[m[0]] if m[0] in _WORDS else _number(m[0]), m.end()
            have = True
        at = _SPACE.match(text, at).end()
        if not open_:
            if at != len(text):
                raise bad()
            return value
        is_object, values, keys = open_[-1]
        values.append(value)
        c, at = text[at : at + 1], _SPACE.match(text, at + 1).end() if at < len(text) else at
        if c == ",":
            have = False
            if is_object:
                at = key(at, keys)
        elif c == ("}" if is_object else "]"):
            value = _object(list(zip(keys, values, strict=True))) if is_object else values
            open_.pop()
        else:
            raise bad()


def number_text(x: float) -> str:
    """A double as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 2**53:
        return str(int(x))
    text = repr(x)
    if "e" not in text:
        return text.removesuffix(".0")
    digits, power = text.split("e")
    if 0 < int(power) < 21:  # the shortest digits, then zeros
        whole, _, rest = digits.partition(".")
        return whole + rest + "0" * (int(power) - len(rest))
    if -7 < int(power) < 0:  # written out where others use a power
        sign, body = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return sign + "0." + "0" * (-int(power) - 1) + body.replace(".", "")
    return f"{digits}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"


def _escaped(text: str) -> str:
    """A text as JSON; lone surrogates, which no UTF-8 holds, as escapes."""
    out = json.dumps(text, ensure_ascii=False)
    return out if out.isascii() else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


def write(value, indent: int | None = None, level: int = 0) -> str:
    """A value as compact JSON, or indented."""
    out: list[str] = []
    todo: list[tuple] = [(value, level)]  # what is left: (value, level), or (None, -1, a text as it is)
    while todo:
        x, at, *raw = todo.pop()
        if raw:
            out.append(raw[0])
        elif isinstance(x, bool) or x is None:
            out.append({True: "true", False: "false", None: "null"}[x])
        elif isinstance(x, (int, float)):
            out.append(number_text(float(x)))
        elif isinstance(x, str):
            out.append(_escaped(x))
        else:
            marks = "{}" if isinstance(x, dict) else "[]"
            if not x:
                out.append(marks)
                continue
            gap, end = ("", "") if indent is None else ("\n" + " " * indent * (at + 1), "\n" + " " * indent * at)
            colon = ":" if indent is None else ": "
            parts: list[tuple] = [(None, -1, marks[0])]
            for i, k in enumerate(x):
                lead = ("," if i else "") + gap
                if isinstance(x, dict):
                    parts += [(None, -1, lead + _escaped(k) + colon), (x[k], at + 1)]
                else:
                    parts += [(None, -1, lead), (k, at + 1)]
            todo += reversed([*parts, (None, -1, end + marks[1])])
    return "".join(out)


def _inner(value: list | dict, path: str) -> Iterator[tuple]:
    """(place, path) of what a list or an object holds."""
    if isinstance(value, list):
        yield from ((i, f"{path}[{i}]") for i in range(len(value)))
    else:
        yield from ((n, f"{path}.{n}" if path else n) for n in list(value))


def places(value, path: str) -> Iterator[tuple]:
    """(holder, place, path) of each scalar in a value, in order: ``holder[place]`` is the scalar, paths are like a.b[0]. A value that is a scalar is held by a list."""
    stack = [([value], iter(((0, path),)))]
    while stack:
        holder, rest = stack[-1]
        for k, p in rest:
            x = holder[k]
            if isinstance(x, (list, dict)):
                stack.append((x, _inner(x, p)))
                break
            yield holder, k, p
        else:
            stack.pop()


def carried(text: str) -> str:
    """The text as valid UTF-8 can hold it: a lone surrogate, or the mark itself, as the mark and its number."""
    return re.sub(f"[{_MARK}\ud800-\udfff]", lambda m: f"{_MARK}{ord(m[0]):04x}", text)


def uncarried(text: str) -> str:
    return _CARRIED.sub(lambda m: chr(int(m[1], 16)), text) if _MARK in text else text

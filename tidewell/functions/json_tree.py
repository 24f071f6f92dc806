"""Strict JSON for records of any depth, and the encodings a member list may come in."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring


class Num(str):
    """The text of a JSON number; keeps integers of any length exact."""


def _no_constant(text: str):
    raise ValueError(f"not JSON: {text}")


_DECODER = json.JSONDecoder(parse_int=Num, parse_float=Num, parse_constant=_no_constant)
_SPACE, _NUMBER = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_WORDS = (("true", True), ("false", False), ("null", None))


def parse(text: str):
    """The value of a complete JSON text, numbers as ``Num``; ValueError for anything else, NaN and the like included."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """As ``parse`` with a stack of its own, for texts nested deeper than the interpreter allows."""
    skip = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple[object, str | None]] = []
    i, n = skip(0), len(text)
    while True:
        c = text[i : i + 1]
        if c in ("[", "{") and c:
            i = skip(i + 1)
            box = [] if c == "[" else {}
            if text[i : i + 1] == ("]" if c == "[" else "}"):
                value, i = box, i + 1
            else:
                key = None
                if c == "{":
                    key, i = _key(text, i, skip)
                stack.append((box, key))
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = Num(m.group()), m.end()
        else:
            for word, value in _WORDS:
                if text.startswith(word, i):
                    i += len(word)
                    break
            else:
                raise ValueError(f"not JSON at {i}")
        while stack:  # the value is complete: put it where it belongs
            box, key = stack.pop()
            i = skip(i)
            end = text[i : i + 1]
            if isinstance(box, list):
                box.append(value)
            else:
                box[key] = value
            if end == ",":
                i = skip(i + 1)
                if isinstance(box, dict):
                    key, i = _key(text, i, skip)
                stack.append((box, key))
                break
            if end != ("]" if isinstance(box, list) else "}"):
                raise ValueError(f"not JSON at {i}")
            value, i = box, i + 1
        else:
            if skip(i) != n:
                raise ValueError(f"more text at {i}")
            return value


def _key(text: str, i: int, skip) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, skip(i + 1)


def position(key: str) -> int | None:
    """A key of digits as a position, if a member column (a 32-bit integer) can hold it."""
    if not (key.isascii() and key.isdigit()) or len(key) > 10 or len(key) == 10 and int(key) >= 1 << 31:
        return None
    return int(key)


def members(body, text_may_be_json: bool = True) -> Iterator[tuple[int, object]]:
    """(position, member) of a member list in any of its encodings; null members are left out and shift no other.

    A list: by index. An object keyed by positions: by key. One object or scalar without a list: at 0. A text that is itself the
    JSON of a list or object: as that. Null or an empty object: none.
    """
    if isinstance(body, str) and not isinstance(body, Num) and text_may_be_json:
        try:
            inner = parse(body)
        except ValueError:
            inner = body
        if isinstance(inner, (list, dict)):
            body = inner
    if body is None:
        return
    if isinstance(body, list):
        pairs = enumerate(body)
    elif isinstance(body, dict):
        if not body:
            return
        at = {k: position(k) for k in body}
        if "datum_type" in body or "datum_body" in body or all(p is None for p in at.values()):
            pairs = iter([(0, body)])
        else:
            pairs = _unique(body, at)
    else:
        pairs = iter([(0, body)])
    for i, m in pairs:
        if m is not None:
            yield i, m


def _unique(body: dict, at: dict) -> list[tuple[int, object]]:
    """Of keys with one position ("1" and "01") the first."""
    out: dict[int, object] = {}
    for k, p in at.items():
        if p is not None:
            out.setdefault(p, body[k])
    return sorted(out.items(), key=lambda x: x[0])

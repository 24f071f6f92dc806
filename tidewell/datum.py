"""The value model: integers, byte strings, texts and tuples of these, with one total order, and its binary forms.

In Python a datum is an ``int`` (64 bits), ``bytes``, ``str`` or ``tuple``. ``None`` stands for a tombstone, outside the model.
"""

from __future__ import annotations

import struct

# --- fixed values: type tags ---
TOMBSTONE, I64, BYTES, STR, TUPLE = 0, 1, 2, 3, 4
TYPE_NAMES = {"int": I64, "bytes": BYTES, "str": STR, "tup": TUPLE}
# --- end of fixed values ---

Datum = int | bytes | str | tuple


def type_of(d: Datum) -> int:
    if isinstance(d, bool) or d is None:
        raise TypeError(f"not a datum: {d!r}")
    for kind, tag in ((int, I64), (bytes, BYTES), (str, STR), (tuple, TUPLE)):
        if isinstance(d, kind):
            return tag
    raise TypeError(f"not a datum: {d!r}")


def encode_key(d: Datum) -> bytes:
    """A form whose byte order is the order of datums; it can be decoded, and concatenated with others without ambiguity."""
    tag = type_of(d)
    if tag == I64:
        return b"\x01" + struct.pack(">Q", d + (1 << 63))
    if tag == TUPLE:
        return b"\x04" + b"".join(map(encode_key, d)) + b"\x00"
    body = d.encode() if tag == STR else d
    return bytes([tag]) + body.replace(b"\x00", b"\x00\x01") + b"\x00\x00"


def _end(key: bytes, at: int) -> int:
    """Where the datum that starts at ``at`` ends."""
    depth = 0
    while True:
        tag = key[at]
        if tag == TOMBSTONE:  # the end of a tuple
            depth -= 1
            at += 1
        elif tag == I64:
            at += 9
        elif tag == TUPLE:
            depth += 1
            at += 1
        else:
            at += 1
            while True:
                at = key.index(0, at) + 1
                if key[at] == 0:
                    at += 1
                    break
        if depth == 0:
            return at


def _decode(key: bytes, at: int) -> tuple[Datum, int]:
    stack: list[list[Datum]] = []
    while True:
        tag = key[at]
        if tag == TUPLE:
            stack.append([])
            at += 1
            continue
        if tag == TOMBSTONE:
            d, at = tuple(stack.pop()), at + 1
        else:
            end = _end(key, at)
            if tag == I64:
                d = struct.unpack_from(">Q", key, at + 1)[0] - (1 << 63)
            else:
                body = key[at + 1 : end - 2].replace(b"\x00\x01", b"\x00")
                d = body.decode() if tag == STR else body
            at = end
        if not stack:
            return d, at
        stack[-1].append(d)


def decode_key(key: bytes) -> Datum:
    d, end = _decode(bytes(key), 0)
    if end != len(key):
        raise ValueError("bytes after the datum")
    return d


def slice_key(key: bytes, path: list[int], tag: int) -> bytes | None:
    """The encoded sub-value at a path of tuple positions, if it is there and of that type; without decoding the rest."""
    at = 0
    for step in path:
        if key[at] != TUPLE:
            return None
        at += 1
        for _ in range(step):
            if key[at] == TOMBSTONE:
                return None
            at = _end(key, at)
        if key[at] == TOMBSTONE:
            return None
    return key[at : _end(key, at)] if key[at] == tag else None


def serialize(d: Datum | None, nested: bool = False) -> bytes:
    """The file form: tag, then the body, with its length where it varies; a nested tuple has no length. None is a tombstone."""
    if d is None:
        return b"\x00"
    tag = type_of(d)
    if tag == I64:
        return b"\x01" + struct.pack("<q", d)
    if tag == TUPLE:
        body = struct.pack("<I", len(d)) + b"".join(serialize(m, True) for m in d)
        return b"\x04" + (b"" if nested else struct.pack("<I", len(body))) + body
    body = d.encode() if tag == STR else d
    return bytes([tag]) + struct.pack("<I", len(body)) + body


class Torn(ValueError):
    """The data end inside a datum."""


def deserialize(data: bytes, at: int = 0, nested: bool = False) -> tuple[Datum | None, int]:
    """The datum at ``at`` and where the next one starts."""
    tag, at = data[at], at + 1
    if tag == TOMBSTONE:
        if nested:
            raise ValueError("a tombstone inside a tuple")
        return None, at
    if tag == I64:
        return struct.unpack_from("<q", data, at)[0], at + 8
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    if tag in (BYTES, STR):
        body = data[at : at + n]
        if len(body) != n:
            raise Torn("the file ends inside a datum")
        return (body.decode() if tag == STR else body), at + n
    if tag != TUPLE:
        raise ValueError(f"unknown type {tag}")
    if not nested:  # n was the body's length
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
    members = []
    for _ in range(n):
        d, at = deserialize(data, at, True)
        members.append(d)
    return tuple(members), at


def render(d: Datum | None) -> str:
    """A readable form."""
    if d is None:
        return "Tombstone"
    tag = type_of(d)
    if tag == TUPLE:
        return "Tuple([" + ", ".join(map(render, d)) + "])"
    return {I64: f"I64({d})", BYTES: f"Bytes({d!r})", STR: f'Str("{d}")'}[tag]

"""Where the plain text of a mail message lies: offsets into the raw text, by code points."""

from __future__ import annotations

import re
from collections.abc import Iterator

_FIELD = re.compile(r"([!-9;-~]+)[ \t]*:(.*)", re.S)
_BOUNDARY = re.compile(r";\s*boundary\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^\s;]+))", re.I)


def lines(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """(start, end without the line break) of each line of text[start:end]."""
    end = len(text) if end is None else end
    out, at = [], start
    while at < end:
        i = text.find("\n", at, end)
        stop = end if i < 0 else i
        out.append((at, stop - 1 if stop > at and text[stop - 1] == "\r" else stop))
        at = stop + 1
    return out


def headers(text: str, rows: list[tuple[int, int]], at: int, last: int) -> tuple[dict[str, str], int]:
    """The fields (lower-case name to unfolded value, the first of each) of lines ``at`` to ``last``, and the line after the blank one.

    A line that is no field and no continuation ends the headers too, and then counts as body.
    """
    out: dict[str, str] = {}
    name = None
    while at < last:
        a, b = rows[at]
        line = text[a:b]
        if not line.strip():
            if line and name is not None and at + 1 < last and _FIELD.match(text[rows[at + 1][0] : rows[at + 1][1]]):
                at += 1  # a folded line of blanks between fields is part of the header
                continue
            return out, at + 1
        if line[0] in " \t" and name is not None:
            out[name] += " " + line.strip()
        elif m := _FIELD.fullmatch(line):
            key = m[1].lower()
            name = key if key not in out else f"{key}\0{at}"
            out[name] = m[2].strip()
        else:
            return out, at
        at += 1
    return out, at


def plain_parts(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the body of each text/plain part, at any level, whose encoding leaves it readable."""
    rows = lines(text)
    todo = [(0, len(rows), "text/plain")]
    while todo:
        first, last, default = todo.pop()
        fields, at = headers(text, rows, first, last)
        given = fields.get("content-type", "")
        kind = given.partition(";")[0].strip().lower() or default
        encoding = fields.get("content-transfer-encoding", "").partition(";")[0].strip().strip('"').lower()
        if kind.startswith("multipart/"):
            m = _BOUNDARY.search(given)
            mark = "--" + (re.sub(r"\\(.)", r"\1", m[1]) if m and m[1] is not None else m[2] if m else "")
            if mark == "--":
                continue
            part_default = "message/rfc822" if kind == "multipart/digest" else "text/plain"
            starts: list[int] = []
            stop = last
            for i in range(at, last):
                a, b = rows[i]
                if text.startswith(mark, a):
                    tail = text[a + len(mark) : b].rstrip()
                    if tail == "":
                        starts.append(i)
                    elif tail == "--":
                        stop = i
                        break
            todo += [(s + 1, e, part_default) for s, e in zip(starts, [*starts[1:], stop])][::-1]
        elif kind == "message/rfc822":
            if encoding not in ("base64", "quoted-printable"):
                todo.append((at, last, "text/plain"))
        elif kind == "text/plain" and encoding not in ("base64", "quoted-printable") and at < last:
            yield rows[at][0], rows[last - 1][1]

"""Content streams of pages: their operations, and the edits that take hidden content out of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import regex

_BLANK, _MARKS = rb"\0\t\n\f\r ", rb"()<>\[\]{}/%"
#: Tokens of the format: strings, dictionaries and arrays are whole ones, whatever is nested in them.
_TOKEN = regex.compile(
    rb"(?P<blank>[" + _BLANK + rb"]+|%[^\r\n]*)"
    rb"|(?P<string>\((?:[^\\()]+|\\.|(?&string))*+(?:\)|\z))"
    rb"|(?P<dict><<(?:[^<>()\[\]%]+|(?&string)|(?&dict)|(?&hex)|[\[\]]|%[^\r\n]*)*+(?:>>|\z))"
    rb"|(?P<hex><[^<>]*+(?:>|\z))"
    rb"|(?P<array>\[(?:[^<>()\[\]%]+|(?&string)|(?&dict)|(?&hex)|(?&array)|%[^\r\n]*)*+(?:\]|\z))"
    rb"|(?P<name>/[^" + _BLANK + _MARKS + rb"]*)"
    rb"|(?P<number>[+.0-9-][^" + _BLANK + _MARKS + rb"]*)"
    rb"|(?P<word>[^" + _BLANK + _MARKS + rb"]+)"
    rb"|(?P<other>.)",
    regex.DOTALL,
)
#: Data of an inline image, up to its end.
_INLINE = regex.compile(rb".*?(?<=[" + _BLANK + rb"])EI(?=[" + _BLANK + _MARKS + rb"]|\z)", regex.DOTALL)


class Operation(NamedTuple):
    name: bytes
    operands: list[tuple[str, bytes]]
    start: int
    end: int


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[str, bytes, int, int]]:
    """kind, bytes, start and end of each token but blanks and comments."""
    while m := _TOKEN.match(data, at):
        if m.lastgroup != "blank":
            yield m.lastgroup, m[0], m.start(), m.end()
        at = m.end()


def operations(data: bytes) -> Iterator[Operation]:
    """Operations with what stands before them; an inline image is one."""
    at = 0
    while at < len(data):
        operands, start = [], None
        for kind, s, a, b in tokens(data, at):
            start = a if start is None else start
            at = b
            if kind != "word":
                operands.append((kind, s))
                continue
            if s == b"BI":
                inside = next((e for k, t, _, e in tokens(data, b) if (k, t) == ("word", b"ID")), len(data))
                found = _INLINE.match(data, inside)
                at = found.end() if found else len(data)
            yield Operation(s, operands, start, at)
            break
        else:
            return


def needs_filter(data: bytes, objects_too: bool) -> bool:
    return b"BDC" in data or (objects_too and regex.search(rb"Do(?:[" + _BLANK + rb"]|\z)", data) is not None)


def edits(data: bytes, hidden_properties: set[bytes], hidden_objects: set[bytes]) -> list[tuple[int, int, bytes]]:
    """(start, end, bytes instead): sections of hidden layers and hidden objects go; marks lose their properties."""
    out, opened = [], []
    for op in operations(data):
        first = op.operands[0] if op.operands else ("", b"")
        inside = any(hidden for _, hidden in opened)
        if op.name in (b"BDC", b"BMC"):
            tag = first[1] if first[0] == "name" else b"/Span"
            prop = op.operands[1] if len(op.operands) > 1 else ("", b"")
            hidden = op.name == b"BDC" and tag == b"/OC" and prop[0] == "name" and prop[1][1:] in hidden_properties
            opened.append((op.start, hidden))
            if op.name == b"BDC" and not hidden and not inside:
                out.append((op.start, op.end, tag + b" BMC "))
        elif op.name == b"EMC":
            start, hidden = opened.pop() if opened else (0, False)
            if hidden and not any(h for _, h in opened):
                out.append((start, op.end, b""))
        elif op.name == b"Do" and not inside and first[0] == "name" and first[1][1:] in hidden_objects:
            out.append((op.start, op.end, b""))
    unending = [s for s, hidden in opened if hidden]  # a hidden section that never ends
    return sorted([*out, *((s, len(data), b"") for s in unending[:1])])


def edited(data: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    parts, at = [], 0
    for start, end, instead in changes:
        parts += [data[at:start], instead]
        at = end
    return b"".join([*parts, data[at:]])


def without_hidden(data: bytes, hidden_properties: set[bytes] = frozenset(), hidden_objects: set[bytes] = frozenset()) -> bytes:
    if not needs_filter(data, bool(hidden_objects)):
        return data
    return edited(data, edits(data, hidden_properties, hidden_objects))

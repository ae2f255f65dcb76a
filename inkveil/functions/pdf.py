"""Objects of PDF files of the classic form (a table of objects, no object streams), and references between them."""

from __future__ import annotations

import re
from typing import NamedTuple

import regex

from inkveil.functions.content import tokens

_HEAD = re.compile(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+obj(?![A-Za-z])")
_TYPE, _KIDS, _LENGTH = re.compile(rb"/Type\s*/([A-Za-z]+)"), re.compile(rb"/Kids\s*\[([^\]]*)\]"), re.compile(rb"/Length\s+([0-9]+)(\s+[0-9]+\s+R)?")
_REF = rb"(?<![^\s()<>\[\]{}/%])([0-9]+)\s+[0-9]+\s+R(?![^\s()<>\[\]{}/%])"
#: References, and what may only look like them: strings, hex strings and comments.
_REF_OR_TEXT = regex.compile(rb"(?:(?P<string>\((?:[^\\()]+|\\.|(?&string))*+\))|<[0-9A-Fa-f\s]*>|%[^\r\n]*)|" + _REF, regex.DOTALL)


class Object(NamedTuple):
    number: int
    kind: str
    body: bytes
    stream: bytes | None
    #: Place among the pages, from 0; None for what is no page.
    page: int | None


def reference(body: bytes, key: bytes) -> int | None:
    m = re.search(rb"/" + key + rb"\s+([0-9]+)\s+[0-9]+\s+R", body)
    return int(m[1]) if m else None


def references(body: bytes) -> list[int]:
    """Distinct numbers of the objects that a body refers to, texts and comments aside."""
    return sorted({int(m[2]) for m in _REF_OR_TEXT.finditer(body) if m[2]})


def rewritten(body: bytes, numbers: dict[int, int]) -> bytes:
    """A body with new numbers; references to objects that are gone become null."""
    new = lambda m: m[0] if not m[2] else b"%d 0 R" % numbers[int(m[2])] if numbers.get(int(m[2])) else b"null"
    return _REF_OR_TEXT.sub(new, body)


def _bodies(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    found, at = {}, 0
    while head := _HEAD.search(data, at):
        stop, end = next(((s, b) for _, s, _, b in tokens(data, head.end()) if s in (b"endobj", b"stream")), (b"", len(data)))
        if not stop:
            raise ValueError(f"object {int(head[1])} has no end")
        body, at, stream = data[head.end() : end - len(stop)], end, None
        if stop == b"stream":
            start = end + (2 if data[end : end + 2] == b"\r\n" else 1)
            length = _LENGTH.search(body)
            size = int(length[1]) if length else -1
            if length and length[2]:
                far = re.search(rb"(?<![0-9])%d\s+[0-9]+\s+obj\s+([0-9]+)" % size, data)
                size = int(far[1]) if far else -1
            if size < 0 or not re.match(rb"\s*endstream", data[start + size : start + size + 20]):
                size = data.index(b"endstream", start) - start
                size -= len(data[start : start + size]) - len(data[start : start + size].rstrip(b"\r\n"))
            stream, at = data[start : start + size], start + size
        found[int(head[1])] = (body.strip(), stream)
    return found


def objects(data: bytes) -> list[Object]:
    """All objects of a file; kind: catalog, info, pages (a node of the tree of pages), page or other."""
    trailer = data.rfind(b"trailer")
    root = reference(data[trailer:], b"Root") if trailer >= 0 and b"startxref" in data[trailer:] else None
    if root is None:
        raise ValueError("no classic table of objects")
    bodies = _bodies(data[:trailer])
    top = reference(bodies[root][0], b"Pages")
    kinds = {root: "catalog"} | {n: "info" for n in (reference(data[trailer:], b"Info"), reference(bodies[root][0], b"Info")) if n}
    leaves, waiting = [], [top]
    while waiting:
        n = waiting.pop()
        kind = _TYPE.search(bodies[n][0])
        kids = _KIDS.search(bodies[n][0])
        if kind and kind[1] == b"Pages":
            kinds[n] = "pages"
            waiting += [int(x) for x in re.findall(rb"([0-9]+)\s+[0-9]+\s+R", kids[1] if kids else b"")][::-1]
        else:
            kinds[n] = "page"
            leaves.append(n)
    order = {n: k for k, n in enumerate(leaves)}
    return [Object(n, kinds.get(n, "other"), body, stream, order.get(n)) for n, (body, stream) in sorted(bodies.items())]


def written(number: int, body: bytes, stream: bytes | None) -> bytes:
    return b"%d 0 obj\n%b\n%bendobj\n" % (number, body, b"" if stream is None else b"stream\n%b\nendstream\n" % stream)

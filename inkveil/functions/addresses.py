"""Addresses of protected people, as entered and on pages.

Each word of a page gets a code by what it can be in one address, and runs of words are patterns over the page's codes:
house number and street, post box, or city and state before a ZIP code.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex

from inkveil.functions import fixed
from inkveil.functions.fuzzy import fold, match
from inkveil.functions.words import Words, ocr_digits, real_digits

_BOX = regex.compile(r"P\.?\s*O\.?\s*Box\s*(\w+)", regex.I)
_ZIP = regex.compile(r"([0-9]{5})(?:-[0-9]{4})?\s*$")
_NUMBER = regex.compile(r"([0-9]+)[A-Za-z]?(?![A-Za-z0-9_])")
_ZIP_LIKE = regex.compile(r"[0-9OoIlSs\-]+")
#: Gaps: s on a line, n over one line break, m over two, u with a number sign before a unit, x too wide or other marks.
_GAP = regex.compile(r"[\s,.#\-]{0,12}")
#: Words that go on with an address, over two line breaks at most; from the gap behind a word that belongs to it.
_ON = regex.compile(r"(?:[su][^.d])*(?:m[^.d](?:[su][^.d])*|(?:n[^.d](?:[su][^.d])*){0,2})")
#: City and state right before a ZIP code.
_CITY = regex.compile(r"(?:[CA]t)+$")
CITY_WORDS, STREET_WORDS = 5, 3


class Address(NamedTuple):
    number: str = ""
    street: tuple[str, ...] = ()
    po_box: str = ""
    unit: str = ""
    city: tuple[str, ...] = ()
    state: str = ""
    zip: str = ""


@lru_cache(1 << 16)
def _plain(s: str) -> str:
    return fold(s).translate({44: None, 35: None})


@lru_cache(1 << 14)
def parse_address(entry: str) -> Address:
    """Parts of an entered address; words after its first line are the city, but for a state."""
    entry = " ".join(entry.split())
    code, box = _ZIP.search(entry), _BOX.search(entry)
    parts = [p.strip() for p in (entry[: code.start()] if code else entry).split(",")]
    street_at = next((k for k, p in enumerate(parts) if _NUMBER.match(p)), None)
    number, street, unit = "", [], ""
    if street_at is not None:
        head, *names = parts[street_at].split(" ")
        number = ocr_digits(head)
        marks = [k for k, w in enumerate(names) if w.startswith("#") or _plain(w) in fixed.UNITS]
        taken = set(marks)
        for k in marks:  # the unit stands in the mark's word or behind it
            here = _plain(names[k]) if names[k].startswith("#") else ""
            unit = here or (_plain(names[k + 1]) if k + 1 < len(names) else "")
            if not here:
                taken.add(k + 1)
        street = [f for k, f in enumerate(map(_plain, names)) if f and k not in taken and f not in fixed.STREETS and f not in fixed.DIRECTIONS]
    city, state = [], ""
    for k, part in enumerate(parts):
        own = [f for f in map(_plain, part.split(" ")) if f]
        if k == street_at or not own or _BOX.search(part):
            continue
        if own[0] in fixed.UNITS:
            unit = own[1] if len(own) > 1 else ""
            continue
        for f in own:
            short = fixed.STATES.get(f) or (f if not state and f in fixed.STATES.values() else "")
            state = short or state
            city += [] if short else [f]
    return Address(number, tuple(street), (ocr_digits(box[1]) or box[1].lower()) if box else "", unit, tuple(city), state, code[1] if code else "")


@lru_cache(1 << 12)
def _gap(g: str) -> str:
    if not _GAP.fullmatch(g):
        return "x"
    breaks = g.count("\n")
    return "x" if breaks > 2 else "m" if breaks == 2 else "n" if breaks else "u" if "#" in g else "s"


class AddressModel:
    """Codes of words in one address: S a street word, C a city word, A the state, U a unit word, X other words of addresses, Z like a ZIP code, d a
    short word with a digit (which counts behind a unit word), a dot anything else."""

    def __init__(self, address: Address):
        self.address = address
        self.known: dict[str, str] = {}

    def code(self, form: str) -> str:
        found = self.known.get(form)
        if found is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            found = self.known[form] = self._code(form)
        return found

    def _code(self, form: str) -> str:
        a, f = self.address, _plain(form)
        if not f:
            return "."
        if f in fixed.UNITS:
            return "U"
        near = lambda names: any(match(form, n) for n in names)
        if near(a.street):
            return "S"
        if near(a.city):
            return "C"
        if a.state and (f == a.state or fixed.STATES.get(f) == a.state):
            return "A"
        if f in fixed.STREETS or f in fixed.DIRECTIONS or f in ("box", "po", "p") or (a.unit and f == a.unit):
            return "X"
        if _ZIP_LIKE.fullmatch(form) and len(ocr_digits(form)) in (5, 9) and real_digits(form) >= 4:
            return "Z"
        return "d" if len(form) <= 6 and real_digits(form) else "."

    def find(self, words: Words) -> list[tuple[int, int]]:
        a, forms = self.address, words.forms
        low = words.low()
        house = [k for k, f in enumerate(words.digits()) if f == a.number and 2 * real_digits(forms[k]) >= max(2, len(a.number))] if a.number and a.street else []
        boxes = [k for k, f in enumerate(low[:-1]) if f == "box" and (words.digits()[k + 1] or low[k + 1]) == a.po_box] if a.po_box else []
        codes_at = [k for k, f in enumerate(forms) if f[:5] == a.zip] if a.zip and a.city else []
        if not (house or boxes or codes_at):
            return []
        spans = self._runs(words, house, boxes) if house or boxes else {}
        for k in codes_at:
            before = _CITY.search(self._city_codes(words, k))
            if before and "C" in before[0]:
                spans.setdefault(k, (words.starts[k - len(before[0]) // 2], words.ends[k]))
        return [spans[k] for k in sorted(spans)]

    def _runs(self, words: Words, house: list[int], boxes: list[int]) -> dict[int, tuple[int, int]]:
        """Spans that begin at house numbers and at words for boxes."""
        low = words.low()
        kinds = [self.code(f) for f in words.forms]
        gaps = list(map(_gap, words.gaps))
        for k, g in enumerate(gaps):  # what's short and has a digit belongs to a unit word, or a number sign, before it
            if kinds[k + 1] == "d" and (kinds[k] == "U" or g == "u"):
                kinds[k + 1] = "X"
        page = words.codes(kinds, lambda _, own=iter(gaps): next(own))
        until = lambda k: words.ends[k + (_ON.match(page, 2 * k + 1).end() - 2 * k - 1) // 2]
        spans = {k: (words.starts[k], until(k)) for k in house if "S" in kinds[k + 1 : k + 1 + STREET_WORDS]}
        for k in boxes:
            first = k
            while first > max(0, k - 2) and low[first - 1] in ("p", "o", "po"):
                first -= 1
            spans.setdefault(k, (words.starts[first], until(k + 1)))
        return spans

    def _city_codes(self, words: Words, k: int) -> str:
        """Codes of the words before a ZIP code, for gaps of blanks, commas and periods on its line."""
        a, out = self.address, []
        for j in range(max(0, k - CITY_WORDS), k):
            is_city = any(match(words.forms[j], n) for n in a.city)
            is_state = a.state and (f := _plain(words.forms[j])) and (f == a.state or fixed.STATES.get(f) == a.state)
            out.append(("C" if is_city else "A" if is_state else ".") + ("t" if not words.gaps[j].strip(" \t,.\xa0") and "\n" not in words.gaps[j] else "x"))
        return "".join(out)


@lru_cache(1 << 13)
def address_models(entries: tuple[str, ...]) -> tuple[AddressModel, ...]:
    return tuple(AddressModel(parse_address(e)) for e in entries)

"""Dates, identifiers and phones of a page in Python: the spans that dates.py and numbers.py give as column expressions, from the same patterns.

Whole tables go this way: a pattern is tried only where a match can begin, and what numbers share of a page is found once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cached_property, lru_cache

import regex

from inkveil.functions import dates, fixed, numbers
from inkveil.functions.text import LEFT, RIGHT
from inkveil.functions.words import ocr_digits, real_digits

Span = tuple[int, int]

#: White space, and what a dot isn't, in the patterns of column expressions.
_SPACE, _BREAKS = " \t\n\x0b\f\r", "\n\r\x85\u2028\u2029"
#: Numbers that aren't decimal digits: words' characters too, but no letters.
_OTHER_NUMBERS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Nl", "No"))
_IN_CLASS = {r"\p{N}": rf"\d{_OTHER_NUMBERS}", r"\s": _SPACE}
_ALONE = {r"\p{L}": rf"[^\W\d_{_OTHER_NUMBERS}]", r"\p{N}": rf"[\d{_OTHER_NUMBERS}]", r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]", r"\z": r"\Z", ".": f"[^{_BREAKS}]"}


def translated(pattern: str) -> str:
    """A pattern of column expressions as Python writes it, without flags and without a ^ at its start."""
    pattern = pattern.replace(LEFT, r"(?<![^\W_])").replace(RIGHT, r"(?![^\W_])").replace(r"[\p{L}\p{N}_]", r"\w").replace("(?iu)", "").removeprefix("^")
    pattern = re.sub(r"\(\?<(?=[a-z])", "(?P<", re.sub(r"\\k<(\w+)>", r"(?P=\1)", pattern))
    out, inside = [], False
    for token in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        out.append((_IN_CLASS if inside else _ALONE).get(token, token))
        inside = token != "]" if inside else token == "["
    return "".join(out)


def _made(pattern: str, module=re):
    return module.compile(translated(pattern), module.I if "(?iu)" in pattern else 0)


def _anywhere(pattern: str, first: str = ""):
    """To find all matches, those that overlap too; first: a class that each begins with."""
    return re.compile(f"{first and f'(?={first})'}(?=({translated(pattern)}))", re.I if "(?iu)" in pattern else 0)


_DIGIT = re.compile("[0-9]")
#: Letters and digits in a row, letters in a row, and places where a number can begin behind marks that are read as digits.
_RUN, _LETTERS, _ANY_START = re.compile(r"[^\W_]+"), re.compile("[A-Za-zıİſ\u212a]+"), re.compile(rf"(?<![^\W_])(?={fixed.OCR_CLASS})", re.I)
#: What is read as a digit, the marks among it, and all that is in either case.
_READ, _MARKS = fixed.OCR_FROM + "0123456789", "|!"
_READ_EITHER = frozenset(c for c in "ıİſ" + "".join(map(chr, range(128))) if re.match(fixed.OCR_CLASS, c, re.I))
#: A page's bytes as digits: look-alikes read, all else deleted.
_AS_DIGITS, _NO_DIGITS = bytes.maketrans(fixed.OCR_FROM.encode(), fixed.OCR_TO.encode()), bytes(k for k in range(256) if chr(k) not in _READ)
_NUMERIC, _ISO, _DAY_FIRST, _COMPACT, _PARTIAL, _GARBLED = map(_made, (dates.NUMERIC, dates.ISO, dates.DAY_FIRST, dates.COMPACT, dates.PARTIAL, dates.GARBLED))
_TIME = _made(dates._TIME)
_SSN_FREE = (_made(numbers.SSN_PARTED), _made(numbers.SSN_PLAIN))
_MASKED, _SSN_MASKED, _SSN_BEHIND = re.compile(f"{numbers._MASK}{{3}}"), _anywhere(numbers.SSN_MASKED, numbers._MASK), _made(numbers._SSN_BEHIND)
_PHONE, _EXTENSION = _anywhere(numbers.PHONE, rf"[ \t+(]|{fixed.OCR_CLASS}"), _made(numbers._EXTENSION)
_PHONE_LOCAL = _made(numbers.PHONE_LOCAL)
#: What begins with letters.
_WORDED = {
    "month": dates.MONTH_FIRST, "birth": dates.BIRTH_LABEL, "ssn": numbers.SSN_LABEL, "bare dl": numbers.BARE["dl"][0], "bare ncic": numbers.BARE["ncic"][0],
    **{cat: pattern for cat, (pattern, _) in numbers.LABELS.items()},
}


def _by_first() -> dict[str, list[tuple[str, Callable]]]:
    """For each letter the patterns that a match can begin with it."""
    own: dict[str, list] = {}
    for name, pattern in _WORDED.items():
        ahead = re.match(r"\(\?=(\[.*?\])\)", pattern)
        first = re.compile(ahead[1] if ahead else "A" if name == "bare ncic" else "[A-Z]")
        for c in filter(first.match, "ıİſ\u212a" + "".join(map(chr, range(128)))):
            own.setdefault(c, []).append((name, _made(pattern).match))
    return own


_BY_FIRST = _by_first()
_FILLER, _NO_ID, _CLOCK = _made(numbers._FILLER), _made(numbers._NO_ID), _made(numbers._CLOCK)
# These look back over a width that varies.
_IDENTIFIER, _IDENTIFIERS = _made(numbers.IDENTIFIER, regex), regex.compile(rf"(?<![A-Za-z0-9]){translated(numbers.IDENTIFIER)}")
_MONTHS = {m[:3]: k for k, m in enumerate(fixed.MONTHS, 1)}


def _int(s: str) -> int | None:
    d = ocr_digits(s)
    return int(d) if d else None


def _valid(year: str, *choices: tuple[int | None, int | None]) -> list[tuple]:
    y = ocr_digits(year)
    found = ((int(y) if y else None, len(y) == 2, m, d) for m, d in choices if m is not None and d is not None and 1 <= m <= 12 and 1 <= d <= 31)
    return list(dict.fromkeys(found))


def _numeric(m) -> list[tuple]:
    if 10 * real_digits(m[0]) < 6 * len(ocr_digits(m[0])):
        return []
    a, b = _int(m[1]), _int(m[3])
    return _valid(m[4], (a, b), (b, a))


def _iso(m) -> list[tuple]:
    return _valid(m[1], (_int(m[3]), _int(m[4]))) if real_digits(m[0]) >= 5 else []


def _named(m, month: int, day: int) -> list[tuple]:
    if real_digits(m[day] + m[3]) < 2:
        return []
    return _valid(m[3], (_MONTHS.get(m[month][:3].lower(), 0), _int(m[day])))


def _compact(m) -> list[tuple]:
    if real_digits(m[0]) < 6:
        return []
    d = ocr_digits(m[0])
    a, b = int(d[:2]), int(d[2:4])
    return list(dict.fromkeys(_valid(d[4:], (a, b), (b, a)) + _valid(d[:4], (int(d[4:6]), int(d[6:])))))


def _overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(start < b and end > a for a, b in spans)


def _trimmed(s: str) -> str:
    return s.rstrip("-/.")


def _is_identifier(s: str, least: int) -> bool:
    return real_digits(s) >= least and len(s) <= numbers.MAX_ID and not _NO_ID.match(s)


@lru_cache(1 << 16)
def _phone_key(entry: str) -> str:
    d = "".join(filter("0123456789".__contains__, entry))
    return _short(d)


def _short(d: str) -> str:
    return d[1:] if len(d) == 11 and d[0] == "1" else d


class Page:
    """A page's text, each line ended by a line feed, and what's found in it."""

    def __init__(self, text: str):
        self.text = text
        self.clean = text.replace("\x01", " ").replace("\x02", " ")
        self.numbered = bool(_DIGIT.search(text))
        #: Where what's read as a digit begins, and where nothing else follows up to a mark or blank, as in all numbers but garbled dates and days before months.
        self.starts: list[int] = []
        self.whole: list[int] = []
        if self.numbered and any(c in text for c in _MARKS):
            self.starts = self.whole = [m.start() for m in _ANY_START.finditer(self.clean)]
        elif self.numbered:
            for m in _RUN.finditer(self.clean):
                run = m[0]
                if run[0] in _READ_EITHER:
                    self.starts.append(m.start())
                    if not run.strip(_READ):
                        self.whole.append(m.start())

    def _at(self, starts: list[int], pattern) -> list:
        match, clean = pattern.match, self.clean
        return [m for k in starts if (m := match(clean, k))]

    @cached_property
    def worded(self) -> dict[str, list]:
        """Matches of what begins with letters, by its name."""
        out: dict[str, list] = {name: [] for name in _WORDED}
        for run in _LETTERS.finditer(self.clean):
            start = run.start()
            for name, match in _BY_FIRST.get(self.clean[start], ()):
                if m := match(self.clean, start):
                    out[name].append(m)
        return out

    def _months(self) -> bool:
        """May a month's name be on the page?"""
        low = self.clean.lower()
        return not low.isascii() or any(m in low for m in _MONTHS)

    @cached_property
    def dates(self) -> list[tuple]:
        """(start, end, partial, readings) as dates.dates() gives them."""
        if not self.numbered:
            return []
        found = [(*m.span(), False, _numeric(m)) for m in self._at(self.whole, _NUMERIC)]
        found += [(*m.span(), False, _iso(m)) for m in self._at(self.whole, _ISO)]
        found += [(*m.span(), False, _named(m, 1, 2)) for m in self.worded["month"]]
        found += [(*m.span(), False, _named(m, 2, 1)) for m in (self._at(self.starts, _DAY_FIRST) if self._months() else ())]
        found += [(*m.span(), False, _compact(m)) for m in self._at(self.whole, _COMPACT)]
        for m in self._at(self.whole, _PARTIAL):
            month = _int(m[1])
            found.append((*m.span(), True, [(_int(m[2]), False, month, None)] if real_digits(m[0]) >= 4 and 1 <= month <= 12 else []))
        return [d for d in found if d[3]]

    @cached_property
    def dated(self) -> list[Span]:
        """dates.date_spans()."""
        if not self.numbered:
            return []
        out = [d[:2] for d in self.dates] + [m.span() for m in self._at(self.starts, _GARBLED)]
        return out + [(start, end + m.end()) for start, end, partial, _ in self.dates if not partial and (m := _TIME.match(self.text[end : end + 8]))]

    def ssn(self) -> list[Span]:
        if not self.numbered:
            return []
        out = []
        for pattern in _SSN_FREE:
            out += [m.span() for m in self._at(self.whole, pattern) if real_digits(m[0]) >= 6 and len(ocr_digits(m[0])) == 9 and not _overlaps(self.dated, *m.span())]
        if _MASKED.search(self.clean):
            out += [m.span(1) for m in _SSN_MASKED.finditer(self.clean) if real_digits(m[1]) >= 3]
        for label in self.worded["ssn"]:
            end = label.end()
            m = _SSN_BEHIND.match(self.text[end : end + 80])
            if m and real_digits(m[1]) >= 4:
                out.append((end + m.start(1), end + m.end(1)))
        return out

    def bare(self, cat: str) -> list[Span]:
        least = numbers.BARE[cat][1]
        return [m.span() for m in self.worded[f"bare {cat}"] if real_digits(m[0]) >= least and not _overlaps(self.dated, *m.span())] if self.numbered else []

    def labelled(self, cat: str) -> list[Span]:
        if not self.numbered:
            return []
        least = numbers.LABELS[cat][1]
        return [s for m in self.worded[cat] if (s := self._value(*m.span(), least))]

    def _value(self, start: int, end: int, least: int) -> Span | None:
        text = self.text
        at = end + _FILLER.match(text[end : end + numbers.FILLER_CHARS]).end()
        line_end = text.find("\n", start)
        if at <= line_end:
            m = _IDENTIFIER.match(text[at : at + 400])
            s = _trimmed(m[0]) if m else ""
            if _is_identifier(s, least):
                return at, at + len(s)
        rest = text[at : max(at, line_end)]
        blank = len(rest) - len(rest.lstrip(_SPACE))
        if blank != len(rest) and at + blank - end < numbers.FAR:
            return None
        low, high = self._column(start) - numbers.LEFT_COLUMNS, self._column(end) + numbers.RIGHT_COLUMNS
        at = text.find("\n", end - 1) + 1
        for _ in range(numbers.LINES_BELOW):
            stop = text.find("\n", at)
            if stop < 0:
                break
            for m in _IDENTIFIERS.finditer(self.clean[at:stop], overlapped=True):
                s = _trimmed(m[0])
                if m.start() + len(s) >= low and m.start() <= high and _is_identifier(s, max(least, numbers.LEAST_BELOW)) and not _CLOCK.match(s):
                    return at + m.start(), at + m.start() + len(s)
            at = stop + 1
        return None

    def _column(self, at: int) -> int:
        return at - self.text.rfind("\n", 0, at) - 1

    def births(self, born: tuple[int, int, int] | None) -> list[Span]:
        """dates.birth_dates(); born: year, month, day."""
        if not self.dates:
            return []
        in_order = sorted(self.dates, key=lambda d: (d[0], -d[1]))
        own = []
        if born:
            y, m, d = born
            own = [x[:2] for x in in_order if not x[2] and any(c[2] == m and c[3] == d and c[0] == (y % 100 if c[1] else y) for c in x[3])]
        for label in self.worded["birth"]:
            start, end = label.span()
            below = None
            for x in in_order:
                if x[0] < end:
                    continue
                lines = self.text.count("\n", start, x[0])
                if lines > dates.NEAR_LINES:
                    break
                if lines == 0 and x[0] - end <= dates.NEAR_CHARS:
                    own.append(x[:2])
                    below = None
                    break
                if lines and below is None:
                    below = x[:2]
            if below:
                own.append(below)
        return own

    def phones(self, entered: list[str]) -> list[Span]:
        """Numbers that are among the entered ones; without an area code too."""
        keys = {k for k in map(_phone_key, entered) if len(k) >= 7} if entered and self.numbered else ()
        ends = {k[-7:] for k in keys}
        digits = self.clean.encode("utf-8", "surrogatepass").translate(_AS_DIGITS, _NO_DIGITS).decode() if keys else ""
        if not any(k in digits for k in ends):
            return []
        out = []
        for m in _PHONE.finditer(self.clean):
            core = _EXTENSION.sub("", m[1])
            if real_digits(core) >= 7 and _short(ocr_digits(core)) in keys:
                out.append(m.span(1))
        return out + [m.span() for m in self._at(self.whole, _PHONE_LOCAL) if real_digits(m[0]) >= 5 and ocr_digits(m[0]) in ends]

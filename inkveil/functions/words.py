"""Words of a page in Python, and pages as strings of codes.

A page's words become a string of one code a word with one code for the gap between neighbours in between, so runs of
words are found by patterns over codes: the word at index k has its code at 2k, the gap behind it stands at 2k + 1.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

from inkveil.functions import fixed

_WORD = regex.compile(r"[\p{L}\p{M}0-9|'’\-]+")
#: The same for texts in ASCII, by the quicker of the two engines.
_ASCII_WORD = re.compile(r"[A-Za-z0-9|'\-]+")
_EDGES = "'’-"
_TO_DIGIT = str.maketrans(fixed.OCR_FROM, fixed.OCR_TO)


@lru_cache(1 << 16)
def ocr_digits(s: str) -> str:
    """Look-alikes become digits, all else goes."""
    return "".join(filter("0123456789".__contains__, s.translate(_TO_DIGIT)))


def real_digits(s: str) -> int:
    return sum(map("0123456789".__contains__, s))


class Words:
    """Starts, ends and forms of a text's words, without marks at their ends; lines counts the line feeds before each."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.forms: list[str] = []
        for m in (_ASCII_WORD if text.isascii() else _WORD).finditer(text):
            form = whole = m[0]
            start, end = m.span()
            if form[0] in _EDGES or form[-1] in _EDGES:
                form = whole.strip(_EDGES)
                if not form:
                    continue
                start += whole.index(form)
                end = start + len(form)
            self.starts.append(start)
            self.ends.append(end)
            self.forms.append(form)
        self.gaps = [text[a:b] for a, b in zip(self.ends, self.starts[1:], strict=False)]
        self._low: list[str] | None = None
        self._digits: list[str] | None = None

    def low(self) -> list[str]:
        """The forms in lower case."""
        if self._low is None:
            self._low = [f.lower() for f in self.forms]
        return self._low

    def digits(self) -> list[str]:
        """The digits of each form as OCR reads them."""
        if self._digits is None:
            self._digits = list(map(ocr_digits, self.forms))
        return self._digits

    def lines(self) -> list[int]:
        out, n = [], self.text.count("\n", 0, self.starts[0]) if self.forms else 0
        for form_gap in self.gaps:
            out.append(n)
            n += form_gap.count("\n")
        return [*out, n] if self.forms else []

    def codes(self, words: list[str], gap_code) -> str:
        """Codes of words and gaps in turn; words has a code for each."""
        parts = [""] * (2 * len(words) - 1) if words else []
        parts[::2] = words
        parts[1::2] = map(gap_code, self.gaps)
        return "".join(parts)

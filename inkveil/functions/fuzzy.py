"""Names under OCR damage: folding, confusion keys, and a weighted edit distance in tenths."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

from inkveil.functions.fixed import CONFUSABLE

_PAIRS = frozenset((a, b) for group in CONFUSABLE for a in group for b in group if a != b)
_KEY = str.maketrans("01|!5$862", "olllssbgz")


@lru_cache(1 << 16)
def fold(s: str) -> str:
    if s.isascii() and s.isalnum():
        return s.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M")).lower()
    return regex.sub("['’`´.]", "", regex.sub("['’`´]s$", "", plain))


@lru_cache(1 << 16)
def ocr_key(s: str) -> str:
    return fold(s).replace("rn", "m").replace("vv", "w").replace("cl", "d").translate(_KEY)


def confusable(a: str, b: str) -> bool:
    return (a, b) in _PAIRS


@lru_cache(1 << 14)
def _near(s: str) -> frozenset[str]:
    """The characters of s and those that are confusable with one."""
    return frozenset(s).union(x for x, y in _PAIRS if y in s)


def distance(a: str, b: str, most: int) -> int | None:
    """Inserting, deleting and swapping neighbours cost 10, replacing 10 or, among confusable characters, 4; None beyond `most`."""
    if abs(len(a) - len(b)) * 10 > most or 10 * (len(a) - sum(map(_near(b).__contains__, a))) > most:  # each character far from all of b's costs 10
        return None
    older: list[int] = []
    above = [10 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [10 * i]
        for j, y in enumerate(b, 1):
            change = 0 if x == y else 4 if (x, y) in _PAIRS else 10
            best = min(above[j] + 10, row[j - 1] + 10, above[j - 1] + change)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 10)
            row.append(best)
        if min(row) > most:
            return None
        older, above = above, row
    return above[-1] if above[-1] <= most else None


#: The key of a word that matches a name has at most so many characters more or less than the name's key: two edits, and one for letters that folding parts.
MOST_LONGER = 3


def tolerance(n: int) -> int:
    """Tenths of edits that a name of n letters forgives."""
    return 4 if n <= 4 else 10 if n <= 7 else 20


@lru_cache(1 << 16)
def match(word: str, name: str) -> tuple[bool, int] | None:
    """(exact, distance in tenths) if word may be the name."""
    w, n = fold(word), fold(name)
    if not w or not n:
        return None
    if w == n:
        return True, 0
    wk, nk = ocr_key(word), ocr_key(name)
    if wk == nk:
        return False, 0
    if len(wk) < 3 or len(nk) < 3:
        return None
    if len(n) <= 5 and wk[0] != nk[0] and not confusable(wk[0], nk[0]):
        return None
    d = distance(wk, nk, tolerance(len(n)))
    return None if d is None else (False, d)

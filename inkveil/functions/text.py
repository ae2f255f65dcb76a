"""Text functions as column expressions: OCR digits, overlapping spans, lines, words, folding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.fixed import OCR_CLASS, OCR_FROM, OCR_TO

#: Not behind, or not before, a letter or digit.
LEFT, RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Marks that find_all() puts into texts; inputs lose them first.
_START, _END = "\u0001", "\u0002"
#: Letters outside ASCII that patterns without case take for one in it.
_FOLDED = {"i": "ıİ", "k": "\u212a", "s": "ſ"}
#: Letters with accents and what folding leaves of them.
ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ", "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC")


def digits(n: int) -> str:
    """Pattern of n digits as OCR reads them, single blanks between."""
    return OCR_CLASS + (f"(?: ?{OCR_CLASS}){{{n - 1}}}" if n > 1 else "")


def ocr_digits(s: Column) -> Column:
    """Look-alikes become digits, all else goes."""
    return F.regexp_replace(F.translate(s, OCR_FROM, OCR_TO), "[^0-9]", "")


def real_digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starting(letters: str) -> str:
    """A lookahead for any of these letters in either case: put before a pattern that ignores case, it passes most places over at once."""
    forms = {x for c in letters for x in (c.lower(), c.upper(), _FOLDED.get(c.lower(), ""))}
    return f"(?=[{''.join(sorted(forms))}])"


def find_all(text: Column, pattern: str) -> Column:
    """All matches as (start, end, s), those that overlap earlier ones too: the search goes on one character behind each match's start."""
    clean = F.replace(F.replace(text, F.lit(_START), F.lit(" ")), F.lit(_END), F.lit(" "))
    marked = F.regexp_replace(clean, f"(?=({pattern}))", f"{_START}$1{_END}")
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    found = lambda at, s: F.struct(at.alias("start"), (at + F.length(s)).alias("end"), s.alias("s"))
    after = lambda a, p, s: F.struct((a["at"] + F.length(p) - F.length(s) - 1).alias("at"), F.concat(a["found"], F.array(found(a["at"], s))).alias("found"))
    step = lambda a, p: let(F.substring_index(p, _END, 1), lambda s: after(a, p, s))
    walk = lambda parts: F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(2))), F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none.alias("found")), step, lambda a: a["found"])
    return let(marked, lambda m: F.when(F.contains(m, F.lit(_START)), let(F.split(m, _START), walk)).when(m.isNotNull(), none))


def newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def line_end(text: Column, at: Column) -> Column:
    """Place of the line feed that ends the line of a place, in a page's text."""
    return F.call_function("locate", F.lit("\n"), text, at + 1) - 1


def column_of(text: Column, at: Column) -> Column:
    """Characters of the line before a place."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1))


def page_text(text: Column) -> Column:
    """A page's text: each line is ended by a line feed, the last one too."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))


def lines(text: Column) -> Column:
    """(line_no, start, end, x0, y0, x1, y1) of each line; 6 by 12 points a character, lines 14 apart, from (20, 20)."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    none = F.array().cast("array<struct<line_no:int,start:int,end:int,x0:double,y0:double,x1:double,y1:double>>")
    box = lambda a, p: F.struct(
        F.size(a["found"]).alias("line_no"), a["at"].alias("start"), (a["at"] + F.length(p)).alias("end"), F.lit(20.0).alias("x0"), (20.0 + 14 * F.size(a["found"])).alias("y0"),
        (20.0 + 6 * F.length(p)).alias("x1"), (32.0 + 14 * F.size(a["found"])).alias("y1"),
    )
    step = lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.concat(a["found"], F.array(box(a, p))).alias("found"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a["found"])


#: A word of a page; apostrophes and hyphens at its ends don't count.
WORD = r"[\p{L}\p{M}0-9|'’\-]+"


def words(text: Column) -> Column:
    """Words of a text in order, without marks at their ends."""
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.regexp_replace(w, r"^['’\-]+|['’\-]+$", ""))
    return F.filter(trimmed, lambda w: w != "")


def fold(s: Column) -> Column:
    """Lower case, no accents, no possessive, apostrophes or periods."""
    plain = F.lower(F.translate(s, *ACCENTS))
    return F.regexp_replace(F.regexp_replace(plain, "['’`´]s$", ""), "['’`´.]", "")


def ocr_key(s: Column) -> Column:
    """Folded, with what OCR confuses collapsed."""
    joined = F.replace(F.replace(F.replace(fold(s), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), F.lit("cl"), F.lit("d"))
    return F.translate(joined, "01|!5$862", "olllssbgz")


def phone_key(s: Column) -> Column:
    """Digits of an entered number, without a leading 1 of eleven."""
    d = F.regexp_replace(s, "[^0-9]", "")
    return F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10)).otherwise(d)


def squash(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"[\s ]+", ""))

"""Dates in texts as column expressions: each date with all readings that it allows, under OCR damage.

A date is (start, end, partial, cands); a reading in cands is (y, y2, m, d), where y2 tells years of two digits. Months with a
year alone are partial and have no day. Dates come by family, then by place; they may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.fixed import MONTHS, OCR_CLASS
from inkveil.functions.text import LEFT, RIGHT, find_all, let, newlines, ocr_digits, real_digits, starting

READING = "struct<y:int,y2:boolean,m:int,d:int>"
DATES = f"array<struct<start:int,end:int,partial:boolean,cands:array<{READING}>>>"
SPANS = "array<struct<start:int,end:int>>"

_D = OCR_CLASS
_MONTH = "(" + "|".join([*MONTHS, "sept", *(m[:3] for m in MONTHS)]) + ")"
_YEAR = f"({_D}{{4}}|{_D}{{2}})"
NUMERIC = rf"{LEFT}({_D}{{1,2}})[ \t]?(?<sep>[-/.])[ \t]?({_D}{{1,2}})[ \t]?\k<sep>[ \t]?{_YEAR}{RIGHT}"
ISO = rf"{LEFT}({_D}{{4}})(?<sep>[-/.])({_D}{{1,2}})\k<sep>({_D}{{1,2}}){RIGHT}"
MONTH_FIRST = rf"{starting('adfjmnos')}(?iu){LEFT}{_MONTH}\.?[ \t]*({_D}{{1,2}})(?:st|nd|rd|th)?,?[ \t]*'?{_YEAR}{RIGHT}"
DAY_FIRST = rf"(?iu){LEFT}({_D}{{1,2}})(?:st|nd|rd|th)?[ \t-]*(?:of[ \t]+)?{_MONTH}\.?,?[ \t-]*{_YEAR}{RIGHT}"
COMPACT = rf"{LEFT}{_D}{{8}}{RIGHT}"
PARTIAL = rf"{LEFT}({_D}{{1,2}})[ \t]?[-/][ \t]?({_D}{{4}}){RIGHT}"
#: Slashes read as strokes, a century read as letters, and maybe a time behind.
_STROKE = r"[ \t]?[-/.lI1|][ \t]?"
GARBLED = rf"{LEFT}{_D}{{1,2}}{_STROKE}{_D}{{1,2}}{_STROKE}(?:[1lI|]9|2[0Oo]){_D}{{2}}(?:[ \t]+{_D}{{3,4}})?"
_TIME = r"^[ \t]+[0-9]{3,4}(?![0-9])"

_LITERAL = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z"

# Labels of birth dates.
_BIRTH = r"D\.?\s?[O0o]\.?\s?B\.?|Date\s*of\s*Birth|Birth\s*-?\s*date|Birth\s+Date|Born(?:\s+on)?|Fecha\s+de\s+Nacimiento"
BIRTH_LABEL = rf"{starting('bdf')}(?iu)(?<!\p{{L}})(?:{_BIRTH})(?!\p{{L}})"
#: Characters behind a label, and lines below it, where its date may stand.
NEAR_CHARS, NEAR_LINES = 60, 2


def _int(s: Column) -> Column:
    return F.nullif(ocr_digits(s), F.lit("")).cast("int")


def _reading(year: Column, month: Column, day: Column) -> Column:
    return let(ocr_digits(year), lambda y: F.struct(F.nullif(y, F.lit("")).cast("int").alias("y"), (F.length(y) == 2).alias("y2"), month.alias("m"), day.alias("d")))


def _valid(choices: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array(*choices), lambda c: c["m"].between(1, 12) & c["d"].between(1, 31)))


def _family(text: Column, pattern: str, enough, choices) -> Column:
    """Dates of one pattern: enough(s, part) tells if real digits suffice, choices(s, part) are readings; part(k) is a group."""

    def date(h: Column) -> Column:
        part = lambda k: F.regexp_extract(h["s"], pattern, k)
        cands = F.when(enough(h["s"], part), _valid(choices(h["s"], part))).otherwise(F.array().cast(f"array<{READING}>"))
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(False).alias("partial"), cands.alias("cands"))

    return F.filter(F.transform(find_all(text, pattern), date), lambda d: F.size(d["cands"]) > 0)


def _month(name: Column) -> Column:
    return F.array_position(F.lit([m[:3] for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int")


def dates(text: Column) -> Column:
    numeric = _family(
        text, NUMERIC, lambda s, _: 10 * real_digits(s) >= 6 * F.length(ocr_digits(s)),
        lambda _, part: [_reading(part(4), _int(part(1)), _int(part(3))), _reading(part(4), _int(part(3)), _int(part(1)))],
    )
    iso = _family(text, ISO, lambda s, _: real_digits(s) >= 5, lambda _, part: [_reading(part(1), _int(part(3)), _int(part(4)))])
    named = [
        _family(text, pattern, lambda _, part, d=day: real_digits(F.concat(part(d), part(3))) >= 2, lambda _, part, m=month, d=day: [_reading(part(3), _month(part(m)), _int(part(d)))])
        for pattern, month, day in ((MONTH_FIRST, 1, 2), (DAY_FIRST, 2, 1))
    ]

    def packed(s: Column, _) -> list[Column]:
        at = lambda k, n: F.substring(ocr_digits(s), k, n)
        return [_reading(at(5, 4), _int(at(1, 2)), _int(at(3, 2))), _reading(at(5, 4), _int(at(3, 2)), _int(at(1, 2))), _reading(at(1, 4), _int(at(5, 2)), _int(at(7, 2)))]

    compact = _family(text, COMPACT, lambda s, _: real_digits(s) >= 6, packed)

    def month_alone(h: Column) -> Column:
        part = lambda k: F.regexp_extract(h["s"], PARTIAL, k)
        cand = F.struct(_int(part(2)).alias("y"), F.lit(False).alias("y2"), _int(part(1)).alias("m"), F.lit(None).cast("int").alias("d"))
        good = (real_digits(h["s"]) >= 4) & cand["m"].between(1, 12)
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(True).alias("partial"), F.when(good, F.array(cand)).alias("cands"))

    partial = F.filter(F.transform(find_all(text, PARTIAL), month_alone), lambda d: d["cands"].isNotNull())
    found = F.concat(*[x.cast(DATES) for x in (numeric, iso, *named, compact, partial)])
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast(DATES))


def date_spans(text: Column, found: Column) -> Column:
    """Where unlabelled numbers aren't identifiers: dates, garbled dates, dates with a time behind them."""
    own = F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end")))
    garbled = F.transform(find_all(text, GARBLED), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    behind = lambda d: F.length(F.regexp_extract(F.substring(text, d["end"] + 1, F.lit(8)), _TIME, 0))
    timed = F.transform(F.filter(found, lambda d: ~d["partial"] & (behind(d) > 0)), lambda d: F.struct(d["start"].alias("start"), (d["end"] + behind(d)).alias("end")))
    return F.when(text.rlike("[0-9]"), F.concat(own.cast(SPANS), garbled.cast(SPANS), timed.cast(SPANS))).otherwise(F.array().cast(SPANS))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def entered_date(s: Column, as_of_year: int) -> Column:
    """(y, m, d) of a date as entered, or null; two-digit years after as_of_year's are of the last century."""
    s = F.trim(F.coalesce(s, F.lit("")))
    part = lambda k: F.regexp_extract(s, _LITERAL, k).cast("int")
    literal = F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))
    year = lambda c: F.when(c["y2"], c["y"] + F.when(c["y"] > as_of_year % 100, 1900).otherwise(2000)).otherwise(c["y"])
    first = F.get(F.get(F.filter(dates(s), lambda d: ~d["partial"]), F.lit(0))["cands"], F.lit(0))
    read = let(first, lambda c: F.when(c.isNotNull(), F.struct(year(c).alias("y"), c["m"].alias("m"), c["d"].alias("d"))))
    return F.when(s.rlike(_LITERAL), literal).otherwise(read)


def same_day(cand: Column, day: Column) -> Column:
    year = F.when(cand["y2"], day["y"] % 100).otherwise(day["y"])
    return (cand["m"] == day["m"]) & (cand["d"] == day["d"]) & (cand["y"] == year)


def birth_dates(text: Column, found: Column, birth: Column) -> Column:
    """Spans of dates that may be the birth date, and of the first date behind or below each label of one."""
    order = lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), b["end"] - a["end"])
    some = lambda own: let(birth, lambda day: let(F.array_sort(own, order), lambda in_order: _birth_dates(text, in_order, day)))
    return F.when(F.size(found) > 0, some(found)).otherwise(F.array().cast(SPANS))


def _birth_dates(text: Column, in_order: Column, birth: Column) -> Column:
    span = lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"))
    own = F.transform(F.filter(in_order, lambda d: ~d["partial"] & F.exists(d["cands"], lambda c: F.coalesce(same_day(c, birth), F.lit(False)))), span)

    def after(label: Column) -> Column:
        lines = lambda d: newlines(F.substring(text, label["start"] + 1, d["start"] - label["start"]))
        later = F.filter(in_order, lambda d: d["start"] >= label["end"])
        beside = F.get(F.filter(later, lambda d: (lines(d) == 0) & (d["start"] - label["end"] <= NEAR_CHARS)), F.lit(0))
        below = F.get(F.filter(later, lambda d: lines(d).between(1, NEAR_LINES)), F.lit(0))
        return let(F.coalesce(beside, below), span)

    labelled = F.filter(F.transform(find_all(text, BIRTH_LABEL), after), lambda s: s["start"].isNotNull())
    return F.concat(own.cast(SPANS), labelled.cast(SPANS))

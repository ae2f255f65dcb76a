"""Numbers that identify a person, as column expressions: Social Security numbers, licences, record and account numbers, phones.

All give arrays of (start, end). Labelled identifiers stand behind their label or, in tables, below it; columns of plain
text stand for places on the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import fixed
from inkveil.functions.dates import SPANS, overlaps
from inkveil.functions.text import LEFT, RIGHT, column_of, digits, find_all, let, line_end, ocr_digits, real_digits, starting

_D = fixed.OCR_CLASS
_DASH = "[-–—.]"
_GAP = rf"(?:[ \t]*{_DASH}[ \t]*|[ \t]{{1,3}})"
SSN_PARTED = rf"{LEFT}(?<!\p{{N}}{_DASH}){digits(3)}{_GAP}{digits(2)}{_GAP}{digits(4)}{RIGHT}(?!{_DASH}\p{{N}})"
SSN_PLAIN = rf"{LEFT}{_D}{{9}}{RIGHT}"
_MASK = "[Xx*#•]"
SSN_MASKED = rf"{LEFT}{_MASK}{{3}}[ \t]*{_DASH}?[ \t]*{_MASK}{{2}}[ \t]*{_DASH}?[ \t]*{digits(4)}{RIGHT}"
SSN_LABEL = rf"{starting(''.join(x[0] for x in fixed.SSN_LABELS))}(?iu)(?<!\p{{L}})(?:{'|'.join(fixed.SSN_LABELS)})(?!\p{{L}})"
_SSN_BEHIND = rf"^[^\n\p{{N}}]{{0,25}}?((?:{_D}[ \t.–—-]{{0,3}}){{8}}{_D}){RIGHT}"

PHONE = (
    rf"(?iu){LEFT}(?:\+?[ \t]?1[ \t]?[\s\-.]?[ \t]?)?(?:\([ \t]?{digits(3)}[ \t]?\)|{digits(3)})[ \t]?[-.\s/]?[ \t]?{digits(3)}[ \t]?[\s\-.]?[ \t]?{digits(4)}{RIGHT}"
    r"(?:[ \t]*(?:extension|ext\.?|x)[ \t]*[0-9]{1,6})?"
)
PHONE_LOCAL = rf"{LEFT}(?<!\p{{N}}[-.\s)]){digits(3)}[ \t]?[-.][ \t]?{digits(4)}{RIGHT}"
_EXTENSION = r"(?iu)(?:extension|ext\.?|x)[ \t]*[0-9]{1,6}\z"

#: For each category: a pattern without a label, and the least number of real digits.
BARE = {"dl": (rf"{LEFT}[A-Z] ?{_D}{{7}}{RIGHT}", 5), "ncic": (rf"{LEFT}A ?{_D}{{8}}{RIGHT}", 6)}


def _label(bare: str, marked: dict[str, str]) -> str:
    """A pattern of words that are labels alone and of those that need a mark behind them."""
    forms = [*bare.split(), *(f"(?:{'|'.join(words.split())}){fixed.MARKS[mark]}" for mark, words in marked.items())]
    first = {x[0].lower() for x in " ".join([bare, *marked.values()]).split()}
    return rf"{starting(''.join(first))}(?iu)(?<!\p{{L}})(?:{'|'.join(forms)})(?!\p{{L}})"


#: For each category: its labels, and the least number of digits of an identifier.
LABELS = {"dl": (_label(fixed.LICENCE_BARE, fixed.LICENCE_MARKED), 4), "ncic": (_label(fixed.RECORD_BARE, fixed.RECORD_MARKED), 3), "account": (_label(fixed.ACCOUNT_BARE, fixed.ACCOUNT_MARKED), 3)}
#: Below a label only longer numbers count; lines below, and columns to the left and right of the label, where they're looked for.
LEAST_BELOW, LINES_BELOW, LEFT_COLUMNS, RIGHT_COLUMNS = 5, 5, 2, 8
#: Columns of blank behind a label from which other text belongs to another column of a table.
FAR = 3
FILLER_CHARS, MAX_ID = 40, 40

_FILLER = r"(?iu)^[\s:#.–=-]*(?:(?:numbers?|num|nbr|no|identifier|ident|id)(?![A-Za-z0-9_])\.?[\s:#.–=-]*)*"
#: Two digits at least in a group that follows a blank, told by looking back from its end.
_MORE = r"(?: [0-9OIl][0-9OIl-]+(?![A-Za-z])(?<=[0-9][OIl-]{0,30}[0-9][OIl-]{0,30}))*"
IDENTIFIER = rf"[A-Za-z0-9*][A-Za-z0-9/.*-]*{_MORE}"
_DAY = r"(?:[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?:\s+[0-9]{3,4})?"
_NO_ID = rf"^(?:\$.*|[0-9]{{1,3}}(?:,[0-9]{{3}})*\.[0-9]{{2}}|{_DAY})\z"
_CLOCK = r"^[0-9]{3,4}\z"

def _spans(found: Column) -> Column:
    return F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).cast(SPANS)


def _if_digits(text: Column, found: Column) -> Column:
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast(SPANS))


def social_security(text: Column, dated: Column) -> Column:
    """Numbers in three groups or in one, unless in a date; masked ones; those behind a label."""
    free = [F.filter(find_all(text, p), lambda h: (real_digits(h["s"]) >= 6) & (F.length(ocr_digits(h["s"])) == 9) & ~overlaps(dated, h["start"], h["end"])) for p in (SSN_PARTED, SSN_PLAIN)]
    masked = F.filter(find_all(text, SSN_MASKED), lambda h: real_digits(h["s"]) >= 3)

    def behind(label: Column) -> Column:
        span = lambda end, s: F.when(real_digits(s) >= 4, F.struct((end - F.length(s)).alias("start"), end.alias("end")))
        matched = lambda s: let(label["end"] + F.length(s), lambda end: let(F.regexp_extract(s, _SSN_BEHIND, 1), lambda number: span(end, number)))
        return let(F.regexp_extract(F.substring(text, label["end"] + 1, F.lit(80)), _SSN_BEHIND, 0), matched)

    labelled = F.array_compact(F.transform(find_all(text, SSN_LABEL), behind))
    return _if_digits(text, F.concat(*map(_spans, (*free, masked)), labelled.cast(SPANS)))


def phones(text: Column, entered: Column) -> Column:
    """Numbers that are among the entered ones; without an area code too."""
    own = lambda s: F.regexp_replace(s, "[^0-9]", "")
    short = lambda d: F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10)).otherwise(d)
    entered = F.filter(F.transform(F.coalesce(entered, F.array().cast("array<string>")), lambda s: short(own(s))), lambda k: F.length(k) >= 7)
    empty = F.array().cast(SPANS)

    def among(keys: Column) -> Column:
        whole_ok = lambda core: let(ocr_digits(core), lambda d: (real_digits(core) >= 7) & F.array_contains(keys, short(d)))
        whole = F.filter(find_all(text, PHONE), lambda h: let(F.regexp_replace(h["s"], _EXTENSION, ""), whole_ok))
        local = lambda ends: F.filter(find_all(text, PHONE_LOCAL), lambda h: (real_digits(h["s"]) >= 5) & F.array_contains(ends, ocr_digits(h["s"])))
        found = F.concat(_spans(whole), let(F.transform(keys, lambda k: F.right(k, F.lit(7))), lambda ends: _spans(local(ends))))
        return F.when((F.size(keys) > 0) & text.rlike("[0-9]"), found).otherwise(empty)

    return let(entered, among)


def bare(text: Column, dated: Column, cat: str) -> Column:
    pattern, least = BARE[cat]
    found = F.filter(find_all(text, pattern), lambda h: (real_digits(h["s"]) >= least) & ~overlaps(dated, h["start"], h["end"]))
    return _if_digits(text, _spans(found))


def is_identifier(s: Column, least: int) -> Column:
    return (real_digits(s) >= least) & (F.length(s) <= MAX_ID) & ~s.rlike(_NO_ID)


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"[-/.]+\z", "")


def labelled(text: Column, cat: str) -> Column:
    """For each label the identifier behind it on its line or, with nothing near behind it, below it.

    A label may wrap: what's behind it must be on its first line, what's below it is below its last."""
    pattern, least = LABELS[cat]

    def value(label: Column) -> Column:
        filler = F.length(F.regexp_extract(F.substring(text, label["end"] + 1, F.lit(FILLER_CHARS)), _FILLER, 0))
        return let(label["end"] + filler, lambda at: let(line_end(text, label["start"]), lambda end: beside(label, at, end)))

    def beside(label: Column, at: Column, end: Column) -> Column:
        found = lambda s: F.when((at <= end) & is_identifier(s, least), F.struct(at.alias("start"), (at + F.length(s)).alias("end")))
        here = let(_trimmed(F.regexp_extract(F.substring(text, at + 1, F.lit(400)), f"^{IDENTIFIER}", 0)), found)
        in_table = lambda rest: let(F.length(F.regexp_extract(rest, r"^\s*", 0)), lambda blank: (blank == F.length(rest)) | (at + blank - label["end"] >= FAR))
        table = let(F.substring(text, at + 1, F.greatest(end - at, F.lit(0))), in_table)
        return F.coalesce(here, F.when(table, let(line_end(text, label["end"] - 1), lambda last: below(label, last))))

    def below(label: Column, end: Column) -> Column:
        lines = F.split(F.regexp_extract(F.substring(text, end + 2, F.length(text)), rf"^(?:[^\n]*\n){{0,{LINES_BELOW}}}", 0), "\n", -1)
        span = lambda start, s: F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"))
        here = lambda line: F.transform(find_all(line, rf"(?<![A-Za-z0-9]){IDENTIFIER}"), lambda h: let(_trimmed(h["s"]), lambda s: span(h["start"], s)))
        empty = F.lit(None).cast("struct<start:int,end:int>")

        def first(line: Column, low: Column, high: Column) -> Column:
            good = lambda h: (h["end"] >= low) & (h["start"] <= high) & is_identifier(h["s"], max(least, LEAST_BELOW)) & ~h["s"].rlike(_CLOCK)
            return F.get(F.filter(here(line), good), F.lit(0))

        def search(low: Column, high: Column) -> Column:
            moved = lambda state, h: F.when(h.isNotNull(), F.struct((state["at"] + h["start"]).alias("start"), (state["at"] + h["end"]).alias("end")))
            hit = lambda state, line: F.coalesce(state["hit"], let(first(line, low, high), lambda h: moved(state, h)))
            step = lambda state, line: F.struct((state["at"] + F.length(line) + 1).alias("at"), hit(state, line).alias("hit"))
            return F.aggregate(lines, F.struct((end + 1).alias("at"), empty.alias("hit")), step, lambda state: state["hit"])

        low, high = column_of(text, label["start"]) - LEFT_COLUMNS, column_of(text, label["end"]) + RIGHT_COLUMNS
        return let(low, lambda a: let(high, lambda b: search(a, b)))

    return _if_digits(text, F.array_compact(F.transform(find_all(text, pattern), value)).cast(SPANS))

"""Checks before the work: profiles, pages without or with little text, hidden layers, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.dates import entered_date

#: Pages of fewer characters, white space not counted, are likely poor scans.
LOW_TEXT = 40
#: Share of dark pixels up to which a page without text is blank.
BLANK_SHARE = 0.001

# Metadata that pages and objects lose, and what a catalogue keeps.
PAGE_KEYS = ("Annots", "B", "Thumb", "AA", "Metadata", "PieceInfo", "StructParents", "ID", "PZ", "SeparationInfo", "Tabs", "LastModified")
OBJECT_KEYS = ("Metadata", "PieceInfo", "LastModified", "StructParent", "StructParents", "OC")
CATALOG_KEYS = ("Type", "Pages")


def chars(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", ""))


def checked(pages: DataFrame, dark_share: Column | None = None) -> DataFrame:
    """pages with chars, low_text, blank and no_text: no text and not blank.

    dark_share: the share of a page's pixels that are dark. A page without text for which it isn't known may hold a picture of text, so it isn't blank."""
    n = chars(F.col("text"))
    blank = (n == 0) & F.coalesce(dark_share <= BLANK_SHARE if dark_share is not None else F.lit(False), F.lit(False))
    return pages.withColumns({"chars": n, "low_text": (n > 0) & (n < LOW_TEXT), "blank": blank, "no_text": (n == 0) & ~blank})


def blocked(pages: DataFrame, file: str, page_no: str) -> DataFrame:
    """file and its pages without text, for files that have any: nothing of them is worked on."""
    return pages.where("no_text").groupBy(file).agg(F.array_sort(F.collect_list(page_no)).alias("pages"))


def admitted(pages: DataFrame, file: str) -> DataFrame:
    return pages.join(pages.where("no_text").select(file).distinct(), file, "left_anti")


def problems(full_name: Column, variants: Column, initials: Column, dob: Column, file_name: Column, size_bytes: Column, as_of_year: int = 2026) -> Column:
    """All that's wrong with a request. What's null is missing."""
    given = lambda c: F.trim(F.coalesce(c, F.lit("")))
    clean = F.filter(F.coalesce(variants, F.array().cast("array<string>")), lambda x: given(x) != "")
    wrong = {
        "no file": file_name.isNull(), "not a PDF file": ~F.lower(file_name).endswith(".pdf"), "file too large": F.coalesce(size_bytes > 2_147_483_647, F.lit(False)), "no name": given(full_name) == "",
        "no variant": F.size(clean) == 0, "no initials": given(initials) == "", "date of birth not understood": (given(dob) != "") & entered_date(dob, as_of_year).isNull(),
    }
    return F.array_compact(F.array(*[F.when(is_so, what) for what, is_so in wrong.items()]))


def clean_list(entry: Column) -> Column:
    """Lines of an entry, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(entry, F.lit("")), "\r?\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def hidden(groups: Column, policy: Column, off: Column) -> Column:
    """Is content of these layers hidden? policy (AnyOn unless given) over the layers' states; while no layer is off nothing is hidden."""
    are_off = F.size(F.filter(groups, lambda g: F.array_contains(off, g)))
    some_off, all_off = are_off > 0, are_off == F.size(groups)
    by_policy = F.when(policy == "AnyOff", ~some_off).when(policy == "AllOn", some_off).when(policy == "AllOff", ~all_off).otherwise(all_off)
    return F.coalesce((F.size(off) > 0) & (F.size(groups) > 0) & by_policy, F.lit(False))


def off_layers(layers: Column, base_off: Column, on: Column, off: Column) -> Column:
    """Layers that are off: those listed as off and, where all are off at first, those that aren't listed as on."""
    return F.array_distinct(F.concat(F.when(base_off, F.array_except(layers, on)).otherwise(F.array().cast("array<string>")), off))


def stripped(metadata: Column, is_page: Column | None = None) -> Column:
    """An object's metadata without the keys that objects lose and, of a page, those that pages lose."""
    drop = lambda keys: F.map_filter(metadata, lambda k, _: ~k.isin(*keys))
    return F.when(is_page if is_page is not None else metadata["Type"] == "Page", drop({*PAGE_KEYS, *OBJECT_KEYS})).otherwise(drop(OBJECT_KEYS))


def allowed(metadata: Column, keep: tuple[str, ...] = CATALOG_KEYS) -> Column:
    return F.map_filter(metadata, lambda k, _: k.isin(*keep))


def with_fields(text: Column, fields: Column) -> Column:
    """A page's text with the values of its form fields (an array of name and value) as lines behind it, so that they are redacted like any text."""
    lines = F.transform(F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != ""), lambda f: F.concat(F.coalesce(f["name"], F.lit("")), F.lit(": "), f["value"]))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat_ws("\n", text, F.array_join(lines, "\n"))).otherwise(text)


def visible(text: Column, parts: Column, off: Column) -> Column:
    """A page's text without the parts (start, end, groups, policy) that belong to hidden layers."""
    gone = F.filter(parts, lambda p: hidden(p["groups"], p["policy"], off))
    ordered = F.array_sort(F.transform(gone, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    step = lambda a, p: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(p["start"] - a["at"], F.lit(0)))).alias("out"), F.greatest(a["at"], p["end"]).alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, rest)

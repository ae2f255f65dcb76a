"""Redaction from pages and subjects to texts, boxes, counts, close forms, statistics and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import fixed
from inkveil.functions.text import lines, page_text
from inkveil.operators import boxes, detect, gate, report


@dataclass
class Result:
    #: keys, redacted text and merged hits of each page.
    pages: DataFrame
    #: keys, cat, start, end, initials.
    hits: DataFrame
    #: keys and groups (cat, initials, rects) without those of duplicate layers, and boxes (rect, initials) to draw.
    boxes: DataFrame
    #: Redactions of each category, those on duplicate layers once.
    counts: DataFrame
    close: DataFrame
    #: Files with pages that have no text, and those pages; none of their pages is in the others.
    blocked: DataFrame
    #: A row for each file, blocked ones too: its status, pages, pages of little text, blank pages, characters, redactions.
    stats: DataFrame


def redact(
    pages: DataFrame, subjects: DataFrame, keys: tuple[str, ...], on: str | None = None, file: str | None = None, page_no: str | None = None, dark_share: Column | None = None,
    fields: str | None = None, layer: str | None = None, store: str | None = None, as_of_year: int = detect.AS_OF_YEAR, first_names: frozenset = fixed.FIRST_NAMES, everyday: frozenset = fixed.EVERYDAY,
) -> Result:
    """Detection, merging and rewriting without a shuffle of texts but the one that spreads pages of few files over the cores.

    file: the column that tells a page's file; a file with pages that have no text, and aren't known to be blank (dark_share),
    is blocked as a whole. Without it each page without text is blocked by itself. fields: a column of form fields (an array of
    name and value), which become lines of the text. layer: the one of keys that tells layers of text of one page. store: a folder
    in which what was found is written once, and from which all results are read; without it each result that is
    used detects anew.
    """
    if fields:
        pages = pages.withColumn("text", gate.with_fields(F.col("text"), F.col(fields)))
    checked, by = gate.checked(pages, dark_share), [file] if file else list(keys)
    stopped = gate.blocked(checked, file, page_no or keys[0]) if file else checked.where("no_text").select(*keys)
    open_pages = gate.admitted(checked, file) if file else checked.where("NOT no_text")
    own_keys = tuple(dict.fromkeys([*keys, *by, *([page_no] if page_no else [])]))
    done = detect.detect(open_pages, subjects, own_keys, on, as_of_year=as_of_year, first_names=first_names, everyday=everyday, rewrite=True)
    if store:
        schema = done.schema
        done.write.mode("overwrite").parquet(store)
        done = done.sparkSession.read.schema(schema).parquet(store)
    placed = done.withColumn("rects", rects_of(F.col("text"), F.col("merged")))
    groups = boxes.page_groups(placed, keys, layer)
    counted = groups.select(F.explode("groups.cat").alias("cat"))
    return Result(
        done.select(*keys, "redacted", "merged"), done.select(*keys, F.inline("merged")), groups.withColumn("boxes", boxes.page_boxes(F.col("groups"))), report.counts(counted),
        report.close_forms(done, page_no or keys[0]), stopped, statistics(checked, done, by, page_no or keys[0]),
    )


def rects_of(text: Column, merged: Column) -> Column:
    """Boxes of each merged span of plain text."""
    own = page_text(text)
    return F.when(F.size(merged) > 0, F.transform(merged, lambda m: boxes.text_rects(own, lines(text), m["start"], m["end"]))).otherwise(F.array().cast("array<array<array<double>>>"))


def statistics(checked: DataFrame, done: DataFrame, by: list[str], page_no: str) -> DataFrame:
    """by, status (ok or blocked), page_count, chars, blank_pages, low_text_pages, no_text_pages (numbers of pages) and redactions."""
    number = lambda c: F.count_if(F.col(c)).alias(f"{c}_pages")
    read = checked.groupBy(*by).agg(F.count("*").alias("page_count"), F.sum("chars").alias("chars"), *map(number, ("low_text", "blank", "no_text")))
    hits = done.groupBy(*by).agg(F.sum(F.size("merged")).cast("long").alias("redactions"))
    status = F.when(F.col("no_text_pages") > 0, "blocked").otherwise("ok").alias("status")
    return read.join(hits, by, "left").select(*by, status, "page_count", "chars", "low_text_pages", "blank_pages", "no_text_pages", F.coalesce("redactions", F.lit(0)).cast("long").alias("redactions"))

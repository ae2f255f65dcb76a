"""Counts, close forms, page ranges and the exceptions report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from inkveil.functions.text import let
from inkveil.schema import categories

#: Numbers of pages that a report's lists start from; more never fit a line.
SHOWN_PAGES = 1000


def counts(hits: DataFrame) -> DataFrame:
    """cat, label, n for all categories in order (sort_no), those without hits too."""
    found = hits.groupBy("cat").agg(F.count("*").alias("found"))
    return categories(hits.sparkSession).join(F.broadcast(found), "cat", "left").select("sort_no", "cat", "label", F.coalesce("found", F.lit(0)).cast("long").alias("n"))


def with_total(counted: DataFrame) -> DataFrame:
    """cat and n, and a last row 'total'."""
    return counted.rollup("cat").agg(F.sum("n").alias("n")).select(F.coalesce("cat", F.lit("total")).alias("cat"), "n")


def page_ranges(pages: Column) -> Column:
    """"1–3, 7, 9–10" for an ascending array of distinct page numbers."""
    def runs_of(own: Column) -> Column:
        first = F.filter(own, lambda p, k: (k == 0) | (F.get(own, k - 1) + 1 != p))
        last = F.filter(own, lambda p, k: (k == F.size(own) - 1) | (F.get(own, k + 1) - 1 != p))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    runs = let(F.transform(pages, lambda p: p.cast("int")), runs_of)
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("–"), r["b"].cast("string")))), ", ")


def shortened(s: Column, n: int) -> Column:
    """At most n characters, cut at a comma, with ", …" if anything was cut."""
    head = lambda own: F.regexp_replace(F.substring(own, 1, n), ",[^,]*$", "")
    return let(s, lambda own: F.when(F.length(own) <= n, own).otherwise(F.concat(head(own), F.lit(", …"))))


def close_form_pages(pages: DataFrame, page_no: str) -> DataFrame:
    """form, page, n, at: how often each form is on each page, and its first place there."""
    each = pages.select(F.col(page_no).alias("page"), F.posexplode("close").alias("at", "form"))
    return each.groupBy("form", "page").agg(F.count("*").alias("n"), F.min("at").alias("at"))


def close_forms(pages: DataFrame, page_no: str) -> DataFrame:
    """form, count, pages (ascending), by count and then first sight: the words redacted as names that aren't on the list.

    A form's pages are in one row; for forms on very many pages close_form_pages() has a row each."""
    by_form = close_form_pages(pages, page_no).groupBy("form")
    found = by_form.agg(F.sum("n").alias("count"), F.sort_array(F.collect_list("page")).alias("pages"), F.min(F.struct("page", "at")).alias("first"))
    return found.orderBy(F.desc("count"), "first").drop("first")


def megabytes(size: Column) -> Column:
    return F.concat(F.format_string("%.1f", size / 1048576.0), F.lit(" MB"))


def seconds(millis: Column) -> Column:
    return F.concat(F.format_string("%.1f", millis / 1000.0), F.lit(" s"))


def run_statistics(pages: DataFrame, page_no: str, file_name: str, low_text: int = 40) -> DataFrame:
    """One row of a run (file_name, page_count, low_text_pages, blank_pages, and of both at most `SHOWN_PAGES` numbers), of checked pages."""
    numbered = pages.select(page_no, F.when((F.col("chars") > 0) & (F.col("chars") < low_text), "low").when(F.col("blank"), "blank").alias("kind"))
    total = numbered.agg(F.count("*").alias("page_count"), F.count_if(F.col("kind") == "low").alias("low_text_count"), F.count_if(F.col("kind") == "blank").alias("blank_count"))
    first = lambda kind: numbered.where(F.col("kind") == kind).orderBy(page_no).limit(SHOWN_PAGES).agg(F.array_sort(F.collect_list(page_no)).alias(f"{kind}_pages"))
    # Each side is one row.
    return total.join(first("low"), F.lit(True)).join(first("blank"), F.lit(True)).select(F.lit(file_name).alias("file_name"), "page_count", "low_text_count", "blank_count", F.col("low_pages").alias("low_text_pages"), "blank_pages")


def report_lines(run: DataFrame, counted: DataFrame, forms: DataFrame, shown: int = 20) -> DataFrame:
    """line_no, section, text, bold of the exceptions report of one run.

    run: one row of file_name, page_count, low_text_pages, blank_pages (of which the first are listed) and, where they are known,
    low_text_count, blank_count, input_bytes, output_bytes, elapsed_ms, processed_at, version, fields_flattened, layers_removed, fallback_pages."""
    has = set(run.columns)
    col = lambda name, other: F.col(name) if name in has else other
    low, blank = col("low_text_count", F.size("low_text_pages")), col("blank_count", F.size("blank_pages"))
    none = F.lit(None).cast("string")
    sizes = F.concat(F.lit("Input "), megabytes(F.col("input_bytes")), F.lit(", output "), megabytes(F.col("output_bytes")), F.lit(", time "), seconds(F.col("elapsed_ms"))) if {"input_bytes", "output_bytes", "elapsed_ms"} <= has else none
    told = F.concat_ws("   ", F.concat(F.lit("Pages: "), "page_count"), F.concat(F.lit("Processed: "), col("processed_at", none)), F.concat(F.lit("Version: "), col("version", none)))
    lines = [
        ("title", F.lit("Exceptions report"), True), ("title", F.lit("Confidential: it lists forms of names that were redacted."), True), ("file", F.concat(F.lit("File: "), "file_name"), False), ("file", told, False),
        ("file", sizes, False), ("file", F.when(col("fields_flattened", F.lit(False)), "Form fields became text before redaction."), False), ("file", F.when(col("layers_removed", F.lit(False)), "Hidden layers were removed."), False),
        ("file", F.when(col("fallback_pages", F.lit(0)) > 0, F.concat(F.lit("Pages whose images were redacted as a whole: "), col("fallback_pages", F.lit(0)))), False),
        ("low text", F.lit("Pages with very little text"), True), ("low text", F.when(low == 0, "None.").otherwise(F.concat(low, F.lit(" page(s): "), shortened(page_ranges(F.col("low_text_pages")), 600))), False),
        ("low text", F.when(blank > 0, F.concat(F.lit("Blank pages: "), shortened(page_ranges(F.col("blank_pages")), 300))), False), ("counts", F.lit("Redactions by category"), True),
    ]
    made = run.select(F.inline(F.array(*[F.struct(F.lit(no).alias("line_no"), F.lit(section).alias("section"), text.cast("string").alias("text"), F.lit(bold).alias("bold")) for no, (section, text, bold) in enumerate(lines)])))
    row = lambda no, section, text, bold=False: [no.cast("int").alias("line_no"), F.lit(section).alias("section"), text.alias("text"), F.lit(bold).alias("bold")]
    each = counted.select(*row(F.col("sort_no") + 20, "counts", F.concat("label", F.lit(": "), "n")))
    total = counted.agg(F.sum("n").alias("n")).select(*row(F.lit(39), "counts", F.concat(F.lit("Total: "), "n"), True))
    title = counted.sparkSession.range(1).select(*row(F.lit(40), "close forms", F.lit("Forms of names that aren't on the list"), True))
    order = W.Window.orderBy(F.desc("count"), "form")
    top = forms.orderBy(F.desc("count"), "form").limit(shown)  # few rows, so one window over them
    form = F.concat(F.lit('"'), "form", F.lit('": '), F.col("count"), F.when(F.size("pages") == 1, " on page ").otherwise(" on pages "), shortened(page_ranges(F.col("pages")), 80))
    listed = top.select(*row(F.row_number().over(order) + 40, "close forms", form))
    # The same columns as those of the list, so that both read one shuffle of the forms.
    more = forms.agg(F.count_if((F.col("count") > 0) & (F.size("pages") > 0)).alias("n"))
    more = more.where((F.col("n") > shown) | (F.col("n") == 0)).select(*row(F.lit(100_000), "close forms", F.when(F.col("n") == 0, "None.").otherwise(F.concat(F.lit("…and "), F.col("n") - shown, F.lit(" more")))))
    return made.union(each).union(total).union(title).union(listed).union(more).where("text IS NOT NULL")

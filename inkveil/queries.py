"""Queries over the engine's operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import addresses, dates, fuzzy, jpeg, names, numbers, text
from inkveil.operators import boxes, detect, gate, images, report, spans
from inkveil.plans.redaction import redact
from inkveil.schema import CATEGORIES, SUBJECT
from inkveil.sources import assembly, pages
from inkveil.streaming.stream import redacted_at_once, stream_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The synthetic records in SQL: the same columns as sources.pages.records().
def _pick(values: tuple[str, ...], k: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({k} % {len(values)} + 1)::INTEGER)"


def _pad(k: str, n: int) -> str:
    return f"lpad(({k})::VARCHAR, {n}, '0')"


_K, _C = "o_orderkey", "o_custkey"
_FIRST, _LAST, _CITY, _ZIP = _pick(pages.FIRST, _C), _pick(pages.LAST, _C), _pick(pages.CITY, _C), f"({_C} % 9000 + 90000)::VARCHAR"
_NUMBER, _AREA, _YEAR = f"({_C} % 9000 + 100)::VARCHAR", f"({_C} % 700 + 200)::VARCHAR", f"({_C} % 50 + 1940)::VARCHAR"
#: SQL of the parts of records, apart from what pages.record_fields() makes of them.
_PARTS = {
    "name": f"{_FIRST} || ' ' || {_LAST}", "reversed_name": f"upper({_LAST}) || ', ' || upper({_FIRST})", "wrapped_name": f"{_FIRST} || chr(10) || {_LAST}", "damaged_name": f"replace(upper({_FIRST} || ' ' || {_LAST}), 'O', '0')",
    "dob": f"{_pad(f'{_C} % 12 + 1', 2)} || '/' || {_pad(f'{_C} % 28 + 1', 2)} || '/' || {_YEAR}", "long_dob": f"{_pick(pages.MONTH_NAMES, _C)} || ' ' || ({_C} % 28 + 1)::VARCHAR || ', ' || {_YEAR}",
    "damaged_dob": f"replace({_pad(f'{_C} % 12 + 1', 2)}, '0', 'O') || '/' || {_pad(f'{_C} % 28 + 1', 2)} || '/' || {_YEAR}",
    "ssn": f"{_pad(f'{_K} % 899 + 100', 3)} || '-' || {_pad(f'{_C} % 80 + 13', 2)} || '-' || {_pad(f'{_K} % 9999 + 1', 4)}", "plain_ssn": f"{_pad(f'{_K} % 899 + 100', 3)} || {_pad(f'{_C} % 80 + 13', 2)} || {_pad(f'{_K} % 9999 + 1', 4)}",
    "masked_ssn": f"'XXX-XX-' || {_pad(f'{_K} % 9999 + 1', 4)}", "damaged_ssn": f"{_pad(f'{_K} % 899 + 100', 3)} || '-' || {_pad(f'{_C} % 80 + 13', 2)} || '-' || replace(replace({_pad(f'{_K} % 9999 + 1', 4)}, '0', 'O'), '1', 'l')",
    "mrn": _pad(_K, 8), "dl": f"chr(({_C} % 26 + 65)::INTEGER) || {_pad(_K, 7)}", "cii": f"'A' || {_pad(_C, 8)}", "visit": "strftime(o_orderdate, '%m/%d/%Y') || ' 1256'",
    "address": f"{_NUMBER} || ' ' || {_pick(pages.STREET, _C)} || ' Road, ' || {_CITY} || ', CA ' || {_ZIP}", "po_box": f"'P.O. Box ' || {_NUMBER} || ', ' || {_CITY} || ', CA ' || {_ZIP}", "city_line": f"{_CITY} || ', CA ' || {_ZIP}",
    "phone": f"'(' || {_AREA} || ') 555-' || {_pad(f'{_C} % 10000', 4)}", "long_phone": f"'+1 ' || {_AREA} || ' 555 ' || {_pad(f'{_C} % 10000', 4)} || ' ext. 12'", "wrapped_phone": f"'(' || {_AREA} || ')' || chr(10) || '555-' || {_pad(f'{_C} % 10000', 4)}",
    "damaged_phone": f"'(' || {_AREA} || ') 555-' || substr({_pad(f'{_C} % 10000', 4)}, 1, 2) || replace(substr({_pad(f'{_C} % 10000', 4)}, 3, 2), '0', 'O')",
}
_KIND = f"CASE WHEN {_K} % 211 = 0 THEN 'empty' WHEN {_K} % 97 = 0 THEN 'fax' ELSE list_extract([{', '.join(map(repr, pages.TEMPLATES))}], ({_K} // 4 % {len(pages.TEMPLATES)} + 1)::INTEGER) END"
_RECORDS = f"SELECT *, {_KIND} AS kind, substr({_FIRST}, 1, 1) || substr({_LAST}, 1, 1) AS initials FROM orders"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _expected(template: str, part: str | None = None) -> list[str]:
    """SELECTs of the spans that a template's parts make by its wording."""
    out, at = [], "0"
    for p in pages.TEMPLATES[template]:
        length = str(len(p)) if isinstance(p, str) else f"length({_PARTS[p[0]]})"
        if not isinstance(p, str) and p[1] and part in (None, p[0]):
            initials = "initials" if p[1] == "name" else "NULL"
            out.append(f"SELECT {_K} AS record_id, '{p[1]}' AS cat, {at} AS \"start\", {at} + {length} AS \"end\", {initials} AS initials FROM r WHERE kind = '{template}'")
        at = f"{at} + {length}"
    return out


def _sql_text(template: str, masked: bool) -> str:
    parts = []
    for p in [*pages.TEMPLATES[template], pages.HARMLESS]:
        mask = not isinstance(p, str) and masked and p[1]
        parts.append(_literal(p) if isinstance(p, str) else ("'[' || initials || ']'" if p[1] == "name" else f"'[{p[1].upper()}]'") if mask else _PARTS[p[0]])
    return " || ".join(parts)


def _texts(masked: bool) -> str:
    cases = " ".join(f"WHEN '{t}' THEN {_sql_text(t, masked)}" for t in pages.TEMPLATES)
    return f"SELECT {_K} AS record_id, {_C} AS subject_id, kind, CASE kind WHEN 'empty' THEN '' WHEN 'fax' THEN 'Fax cover' {cases} END AS text FROM r"


_HITS = f"WITH r AS ({_RECORDS}) " + " UNION ALL ".join(x for t in pages.TEMPLATES for x in _expected(t))
_REDACTED = f"WITH r AS ({_RECORDS}) SELECT record_id, text AS redacted FROM ({_texts(True)})"


def _hits(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = detect.DETECTORS, kind: str | None = None) -> DataFrame:
    """Merged hits of the records (of one template), each against its own subject's profile."""
    own = pages.records(spark, sf_dir)
    found = detect.detect(own.where(F.col("kind") == kind) if kind else own, pages.subjects(spark, sf_dir), ("record_id",), "subject_id", only, rewrite=True)
    return found.select("record_id", F.inline("merged"))


def _dark_share() -> Column:
    """Empty records are blank pages if their number is even."""
    return F.when(F.col("record_id") % 2 == 1, 0.2).otherwise(0.0)


@query(_HITS)
def record_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


for _name, _only, _cat in (
    ("ssn_hits", "ssn", "ssn"), ("dl_hits", "dl", "dl"), ("ncic_hits", "ncic", "ncic"), ("account_hits", "account", "account"), ("dob_hits", "dob", "dob"),
    ("address_hits", "addresses", "address"), ("phone_hits", "phones", "phone"), ("name_hits", "names", "name"),
):
    QUERIES[_name] = lambda spark, sf_dir, only=_only: _hits(spark, sf_dir, (only,))
    ORACLE_SQL[_name] = f"SELECT * FROM ({_HITS}) WHERE cat = '{_cat}'"


# One way to write each kind of data, by its template.
for _name, _only, _template, _part in (
    ("ssn_formatted", "ssn", "form", "ssn"), ("ssn_masked", "ssn", "letter", "masked_ssn"), ("ssn_plain", "ssn", "table", "plain_ssn"), ("ssn_labeled", "ssn", "damaged", "damaged_ssn"),
    ("dob_exact", "dob", "form", "dob"), ("dob_month_name", "dob", "letter", "long_dob"), ("dob_damaged", "dob", "damaged", "damaged_dob"),
    ("account_inline", "account", "form", "mrn"), ("account_below", "account", "table", "mrn"), ("account_wrapped_label", "account", "wrapped", "mrn"), ("ncic_labeled", "ncic", "table", "cii"), ("dl_labeled", "dl", "table", "dl"),
    ("phone_extension", "phones", "letter", "long_phone"), ("phone_two_lines", "phones", "wrapped", "wrapped_phone"), ("phone_damaged", "phones", "damaged", "damaged_phone"),
    ("po_box", "addresses", "letter", "po_box"), ("city_state_zip", "addresses", "wrapped", "city_line"), ("street_address", "addresses", "form", "address"),
    ("name_reversed", "names", "form", "reversed_name"), ("name_runs", "names", "wrapped", "wrapped_name"), ("name_damaged", "names", "damaged", "damaged_name"),
):
    QUERIES[_name] = lambda spark, sf_dir, only=_only, kind=_template: _hits(spark, sf_dir, (only,), kind)
    ORACLE_SQL[_name] = f"WITH r AS ({_RECORDS}) " + _expected(_template, _part)[0]


@query(_REDACTED)
def redacted_text(spark, sf_dir):
    done = redact(pages.records(spark, sf_dir), pages.subjects(spark, sf_dir), ("record_id",), "subject_id", dark_share=F.lit(0.0))
    return done.pages.select("record_id", "redacted")


@query(f"SELECT o_custkey AS file, list_sort(list(o_orderkey)) AS pages FROM orders WHERE {_K} % 211 = 0 AND o_orderkey % 2 = 1 GROUP BY 1")
def blocked_files(spark, sf_dir):
    """Files (here: subjects) with pages that have no text but dark pixels, as the whole plan stops them."""
    own = pages.records(spark, sf_dir)
    done = redact(own, pages.subjects(spark, sf_dir), ("record_id",), "subject_id", file="subject_id", page_no="record_id", dark_share=_dark_share())
    return done.blocked.withColumnRenamed("subject_id", "file")


@query(f"""
    WITH r AS ({_RECORDS}), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 211 = 0 AND o_orderkey % 2 = 1),
    h AS (SELECT {_C} AS file, count(*) AS n FROM ({_HITS}) JOIN orders ON record_id = o_orderkey GROUP BY 1)
    SELECT r.o_custkey AS file, CASE WHEN b.o_custkey IS NULL THEN 'ok' ELSE 'blocked' END AS status, count(*) AS page_count, sum(length(regexp_replace(text, '\\s+', '', 'g')))::BIGINT AS chars,
        count(*) FILTER (kind = 'fax') AS low_text_pages, count(*) FILTER (kind = 'empty' AND record_id % 2 = 0) AS blank_pages, count(*) FILTER (kind = 'empty' AND record_id % 2 = 1) AS no_text_pages,
        CASE WHEN b.o_custkey IS NULL THEN coalesce(any_value(h.n), 0) ELSE 0 END AS redactions
    FROM ({_texts(False)}) t JOIN (SELECT DISTINCT o_custkey FROM orders) r ON t.subject_id = r.o_custkey LEFT JOIN b ON b.o_custkey = r.o_custkey LEFT JOIN h ON h.file = r.o_custkey GROUP BY r.o_custkey, b.o_custkey
""")
def run_stats(spark, sf_dir):
    """Status, pages, characters and redactions of each file."""
    own = pages.records(spark, sf_dir)
    done = redact(own, pages.subjects(spark, sf_dir), ("record_id",), "subject_id", file="subject_id", page_no="record_id", dark_share=_dark_share())
    return done.stats.withColumnRenamed("subject_id", "file")


@query(f"""
    WITH r AS ({_RECORDS}) SELECT {_K} AS record_id, 'MRN note' || chr(10) || 'Name: ' || {_PARTS["name"]} || chr(10) || 'Born: ' || {_PARTS["dob"]} AS text,
        'MRN note' || chr(10) || 'Name: [' || initials || ']' || chr(10) || 'Born: [DOB]' AS redacted FROM r
""")
def form_fields(spark, sf_dir):
    """Values of form fields are redacted like text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = pages.record_fields(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    own = orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("subject_id"), F.lit("MRN note").alias("text"), F.array(field("Name", part["name"]), field("Empty", F.lit("")), field("Born", part["dob"])).alias("fields"))
    done = redact(own, pages.subjects(spark, sf_dir), ("record_id",), "subject_id", fields="fields")
    texts = own.select("record_id", gate.with_fields(F.col("text"), F.col("fields")).alias("text"))
    return texts.join(done.pages.select("record_id", "redacted"), "record_id")


@query(f"WITH h AS ({_HITS}), c AS (SELECT unnest([{', '.join(repr(c) for c in CATEGORIES)}]) AS cat) SELECT c.cat, count(h.record_id) AS n FROM c LEFT JOIN h USING (cat) GROUP BY 1")
def counts_zero_filled(spark, sf_dir):
    return report.counts(_hits(spark, sf_dir)).select("cat", "n")


@query(f"WITH h AS ({_HITS}) SELECT coalesce(cat, 'total') AS cat, count(*) AS n FROM h GROUP BY ROLLUP (cat)")
def counts_rollup(spark, sf_dir):
    return report.with_total(report.counts(_hits(spark, sf_dir)).where("n > 0"))


_SECRETS = {t: [p[0] for p in parts if not isinstance(p, str) and p[1]] for t, parts in pages.TEMPLATES.items()}


@query(f"""
    WITH r AS ({_RECORDS}), t AS ({_texts(True)}), u AS ({_texts(False)})
    SELECT u.kind, count(*) AS n, count(*) FILTER (u.text <> t.text) AS changed, 0::BIGINT AS leaks, count(*) FILTER (contains(t.text, '{pages.HARMLESS}')) AS kept FROM u JOIN t USING (record_id) GROUP BY 1
""")
def leak_check(spark, sf_dir):
    """Pages of each template, those that changed, those that still hold any of their secrets as written there (white space and case aside), and those whose harmless line survived."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = pages.record_fields(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"))
    secret = F.array().cast("array<string>")
    for kind, names in _SECRETS.items():
        secret = F.when(pages.record_kind(F.col("o_orderkey")) == kind, F.array(*[part[n] for n in names])).otherwise(secret)
    records = pages.records(spark, sf_dir)
    done = redact(records, pages.subjects(spark, sf_dir), ("record_id",), "subject_id", dark_share=F.lit(0.0)).pages
    every = records.select("record_id", "kind", "text").join(orders.select(F.col("o_orderkey").alias("record_id"), secret.alias("secrets")), "record_id").join(done, "record_id")
    leaks = text.let(text.squash(F.col("redacted")), lambda own: F.exists("secrets", lambda x: F.contains(own, text.squash(x))))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("text") != F.col("redacted")).alias("changed"), F.count_if(leaks).alias("leaks"), F.count_if(F.col("redacted").contains(pages.HARMLESS)).alias("kept"))


@query(f"SELECT source AS file, count(*) AS pages_out, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes_in FROM documents GROUP BY 1")
def conservation_check(spark, sf_dir):
    """Pages that were written and read again, and bytes that went in, by file: none gets lost."""
    docs = pages.documents(spark, sf_dir, numbered=False)
    who = spark.createDataFrame([(0, "Ottoline Brackwater", [], "OB", "", [], ["(838) 555-7235"], [], [], [])], SUBJECT)
    done = redact(docs, who, ("file", "doc_id"), dark_share=F.lit(0.0), store=stream_folder(spark))
    out = done.pages.groupBy("file").agg(F.count("*").alias("pages_out"))
    return out.join(docs.groupBy("file").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes_in")), "file")


@query("""
    WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM p)
    SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER w, 0)::BIGINT AS "start", (coalesce(sum(length(line) + 1) OVER w, 0) + length(line))::BIGINT AS "end"
    FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def lines_of_page(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.inline(text.lines(F.col("text"))))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_TOKENS = r"""
    WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\pL\pM0-9|''’\-]+'), lambda x: regexp_replace(regexp_replace(x, '^[''’\-]+', ''), '[''’\-]+$', '')), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id, unnest(ws) AS raw, (generate_subscripts(ws, 1) - 1)::BIGINT AS word_no FROM w
"""


def _tokens(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(text.words(F.col("text"))).alias("word_no", "raw"))


@query(_TOKENS)
def tokens_of_page(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", "raw", F.col("word_no").cast("long").alias("word_no"))


@query(f"SELECT DISTINCT raw, regexp_replace(translate(raw, 'OoQDIil|!SsBZzG', '000011111558226'), '[^0-9]', '', 'g') AS ocr, length(regexp_replace(raw, '[^0-9]', '', 'g')) AS real_digits FROM ({_TOKENS})")
def ocr_digits_tokens(spark, sf_dir):
    own = _tokens(spark, sf_dir).select("raw").distinct()
    return own.select("raw", text.ocr_digits(F.col("raw")).alias("ocr"), text.real_digits(F.col("raw")).cast("long").alias("real_digits"))


_FOLD = f"regexp_replace(regexp_replace(lower(translate(raw, '{text.ACCENTS[0]}', '{text.ACCENTS[1]}')), '[''’`´]s$', ''), '[''’`´.]', '', 'g')"


@query(f"SELECT DISTINCT raw, {_FOLD} AS folded, translate(replace(replace(replace({_FOLD}, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '01|!5$862', 'olllssbgz') AS ocr_key FROM ({_TOKENS})")
def fold_tokens(spark, sf_dir):
    own = _tokens(spark, sf_dir).select("raw").distinct()
    return own.select("raw", text.fold(F.col("raw")).alias("folded"), text.ocr_key(F.col("raw")).alias("ocr_key"))


@query("SELECT doc_id, length(regexp_replace(text, '[\\s ]+', '', 'g')) AS chars, length(regexp_replace(text, '[\\s ]+', '', 'g')) BETWEEN 1 AND 39 AS low_text FROM documents")
def page_charcounts(spark, sf_dir):
    return gate.checked(pages.documents(spark, sf_dir, numbered=False)).select("doc_id", F.col("chars").cast("long").alias("chars"), "low_text")


@query("SELECT count(*) AS pages, count(DISTINCT o_custkey) AS files FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 211 = 0 AND o_orderkey % 2 = 1)")
def admitted_files(spark, sf_dir):
    own = gate.checked(pages.records(spark, sf_dir), _dark_share())
    return gate.admitted(own, "subject_id").agg(F.count("*").alias("pages"), F.countDistinct("subject_id").alias("files"))


@query("SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 211 = 0 AND o_orderkey % 2 = 0")
def blank_pages(spark, sf_dir):
    own = gate.checked(pages.records(spark, sf_dir), _dark_share())
    return own.where("blank").select("record_id")


@query("""
    WITH p AS (SELECT DISTINCT o_custkey AS file, o_orderkey % 40 AS page FROM orders), g AS (SELECT *, page - row_number() OVER (PARTITION BY file ORDER BY page) AS island FROM p),
    r AS (SELECT file, min(page) AS a, max(page) AS b FROM g GROUP BY file, island)
    SELECT file, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '–' || b::VARCHAR END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1
""")
def page_ranges(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("file")).agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 40)).alias("pages"))
    return own.select("file", report.page_ranges(F.col("pages")).alias("ranges"))


def _line_hits(spark, sf_dir) -> DataFrame:
    """Spans made of order lines: they overlap, touch and nest."""
    at = F.col("l_linenumber") * 7 + F.col("l_partkey") % 11
    cats = F.element_at(F.lit(list(CATEGORIES)), (F.col("l_suppkey") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("page"), cats.alias("cat"), at.cast("int").alias("start"), (at + F.col("l_partkey") % 9).cast("int").alias("end"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 9).cast("int").alias("ord"), F.lit("OB").alias("initials"))


_LINE_HITS = f"SELECT l_orderkey AS page, list_extract([{', '.join(repr(c) for c in CATEGORIES)}], (l_suppkey % 9 + 1)::INTEGER) AS cat, l_linenumber * 7 + l_partkey % 11 AS s, l_linenumber * 7 + l_partkey % 11 + l_partkey % 9 AS e, l_linenumber * 10 + l_suppkey % 9 AS ord FROM lineitem"
_ISLANDS = f"""
    WITH h AS ({_LINE_HITS}), o AS (SELECT *, coalesce(max(e) OVER (PARTITION BY page ORDER BY s, e DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS joined FROM h WHERE e > s),
    i AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY s, e DESC, ord) AS island FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY page, island ORDER BY cat = 'name', s, e DESC, ord) AS k FROM i)
    SELECT page, max(cat) FILTER (k = 1) AS cat, min(s)::INTEGER AS "start", max(e)::INTEGER AS "end" FROM r GROUP BY page, island
"""


@query(_ISLANDS)
def merge_islands(spark, sf_dir):
    """By windows."""
    return spans.merge_islands(_line_hits(spark, sf_dir), ("page",))


@query(_ISLANDS)
def merge_in_place(spark, sf_dir):
    """The same by a fold over each page's hits."""
    own = _line_hits(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct("cat", "start", "end", "ord", "initials")).alias("hits"))
    return own.select("page", F.inline(spans.merged(F.col("hits")))).drop("initials")




@query("SELECT c_custkey, 'Customer' AS first, lpad(c_custkey::VARCHAR, 9, '0') AS last, 'C0' AS initials FROM customer")
def parse_name(spark, sf_dir):
    """Names of customers, every second one written last name first."""
    plain = F.regexp_replace("c_name", "#", " ")
    entry = F.when(F.col("c_custkey") % 2 == 0, plain).otherwise(F.concat(F.element_at(F.split(plain, " "), 2), F.lit(", "), F.element_at(F.split(plain, " "), 1), F.lit(" Jr")))

    @F.pandas_udf("first string, last string, initials string")
    def parts(s: pd.Series) -> pd.DataFrame:
        found = s.map(names.parse_name)
        return pd.DataFrame({"first": found.str[0], "last": found.str[2], "initials": s.map(names.initials_for)})

    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parts(entry).alias("p")).select("c_custkey", "p.*")


@query("""
    SELECT c_custkey, list_filter([CASE WHEN c_custkey % 17 = 0 THEN 'no file' END, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 5 = 0 THEN 'not a PDF file' END, CASE WHEN c_custkey % 7 = 0 THEN 'file too large' END,
        CASE WHEN c_custkey % 3 = 0 THEN 'no name' END, CASE WHEN c_custkey % 4 = 0 THEN 'no variant' END, CASE WHEN c_custkey % 11 = 0 THEN 'no initials' END, CASE WHEN c_custkey % 13 = 0 THEN 'date of birth not understood' END], lambda x: x IS NOT NULL) AS problems FROM customer
""")
def profile_validation(spark, sf_dir):
    """Blank and null entries, dates in several forms, and all problems of each."""
    k = F.col("c_custkey")
    blank = lambda n, good: F.when(k % (2 * n) == 0, F.lit(None)).when(k % n == 0, F.lit(" ")).otherwise(good)
    good_date = F.element_at(F.lit(["4/23/81", "April 23, 1981", "1981-04-23", "23 Apr 1981", ""]), (k % 5 + 1).cast("int"))
    found = gate.problems(
        blank(3, F.col("c_name")), F.when(k % 8 == 0, F.lit(None)).otherwise(F.array(blank(4, F.col("c_name")), F.lit(""))), blank(11, F.lit("OB")), F.when(k % 13 == 0, "soon").otherwise(good_date),
        F.when(k % 17 == 0, F.lit(None)).when(k % 5 == 0, "chart.doc").otherwise("Chart.PDF"), F.when(k % 7 == 0, 3_000_000_000).otherwise(1000),
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", found.alias("problems"))


@query("SELECT c_custkey, list_filter(list_transform(string_split(c_name || chr(10) || ' ' || c_mktsegment || ' ' || chr(10) || chr(10), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS entries FROM customer")
def list_entries(spark, sf_dir):
    entry = F.concat_ws("\n", "c_name", F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")), F.lit(""), F.lit(""))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", gate.clean_list(entry).alias("entries"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || '.pdf' END || '_REDACTED.pdf' AS redacted, s_name || '_EXCEPTIONS.pdf' AS exceptions FROM (SELECT s_suppkey, s_name, 1 AS one FROM supplier) WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name || '_REDACTED.pdf', s_name || '_EXCEPTIONS.pdf' FROM supplier WHERE s_suppkey % 2 = 1")
def output_names(spark, sf_dir):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 1, ".PDF").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", *[c.alias(n) for n, c in pages.output_names(name).items()])


@query("SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace((l_orderkey * 37 % 100000000000)::VARCHAR, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\\1') AS key FROM (SELECT l_orderkey + 10000000000 + l_linenumber * 7000000000 AS l_orderkey, l_linenumber FROM lineitem)")
def phone_keys(spark, sf_dir):
    k = F.col("l_orderkey") + 10_000_000_000 + F.col("l_linenumber").cast("long") * 7_000_000_000
    d = (k * 37 % 100_000_000_000).cast("string")
    entered = F.concat(F.lit("+"), F.regexp_replace(d, "([0-9]{4})$", "-$1"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(k.alias("l_orderkey"), F.col("l_linenumber"), text.phone_key(entered).alias("key"))


#: A phone number as OCR may have read it; group of ten digits with usual separators.
PHONE = text.LEFT + r"(?:\+?[ \t]?[1Iil|!][ \t]?[-. ]?)?(?:\(" + text.digits(3) + r"\)|" + text.digits(3) + r")[-. /]?[ ]?" + text.digits(3) + r"[-. ]?" + text.digits(4) + text.RIGHT
_D = "[0-9OoQDIil|!SsBZzG]"
_SQL_PHONE = rf"^((?:\+?[ \t]?[1Iil|!][ \t]?[-. ]?)?(?:\({_D}(?: ?{_D}){{2}}\)|{_D}(?: ?{_D}){{2}})[-. /]?[ ]?{_D}(?: ?{_D}){{2}}[-. ]?{_D}(?: ?{_D}){{3}})(?:$|[^\pL\pN])"


@query(rf"""
    WITH d AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE length(regexp_replace(text, '[^0-9]', '', 'g')) >= 7),
    s AS MATERIALIZED (SELECT doc_id, i, substr(text, i, 40) AS win FROM d WHERE regexp_matches(substr(text, i, 1), '[0-9OoQDIil|!SsBZzG(+]') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\pL\pN]'))),
    m AS (SELECT doc_id, i, regexp_extract(win, '{_SQL_PHONE}', 1) AS s FROM s)
    SELECT doc_id, (i - 1)::INTEGER AS "start", (i - 1 + length(s))::INTEGER AS "end", s FROM m WHERE length(regexp_replace(s, '[^0-9]', '', 'g')) >= 7
""")
def phone_candidates(spark, sf_dir):
    """All that looks like a phone number, overlapping ones too, by expressions alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike("[0-9]")).where(text.real_digits(F.col("text")) >= 7)
    found = docs.select("doc_id", F.inline(text.find_all(F.col("text"), PHONE)))
    return found.where(text.real_digits(F.col("s")) >= 7)


_KEY = f"({_C} % 700 + 200)::VARCHAR || '555' || lpad(({_C} % 10000)::VARCHAR, 4, '0')"


@query(f"""
    WITH r AS ({_RECORDS}), k AS (SELECT DISTINCT {_KEY.replace(_C, "c_custkey")} AS key FROM customer WHERE c_custkey % 2 = 0)
    SELECT {_K} AS record_id FROM r WHERE kind IN ('form', 'letter', 'damaged', 'wrapped') AND {_KEY} IN (SELECT key FROM k)
""")
def phone_semi_join(spark, sf_dir):
    """Records with a phone number of any customer with an even key."""
    c = F.col("c_custkey")
    entered = spark.read.parquet(f"{sf_dir}/customer.parquet").where(c % 2 == 0).select(text.phone_key(pages.record_fields(c, c, F.lit("2020-01-01").cast("timestamp"))["phone"]).alias("key")).distinct()
    found = pages.records(spark, sf_dir).where(F.col("text").rlike("[0-9]")).select("record_id", F.inline(text.find_all(text.page_text(F.col("text")), numbers.PHONE)))
    digits = text.ocr_digits(F.regexp_replace("s", r"(?i)\s*ext\..*", ""))
    keyed = found.select("record_id", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits).alias("key"))
    return keyed.join(entered, "key", "left_semi").select("record_id").distinct()


@query(f"WITH r AS ({_RECORDS}), t AS (SELECT {_K} AS record_id, {_K} % 80 AS gap FROM r) SELECT record_id, (4 + gap)::INTEGER AS \"start\", (14 + gap)::INTEGER AS \"end\" FROM t WHERE gap < 60")
def dob_labeled_asof(spark, sf_dir):
    """The first date behind a label, if it's near enough; an other date stands two lines below."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("DOB:"), F.repeat(F.lit(" "), (F.col("o_orderkey") % 80).cast("int")), F.lit("01/02/1990 and 03/04/1991\n")).alias("t"))
    found = dates.birth_dates(F.col("t"), dates.dates(F.col("t")), dates.entered_date(F.lit(""), 2026))
    return own.select("record_id", F.inline(found))


@query("""
    WITH t AS (SELECT o_orderkey AS record_id, o_orderkey % 14 AS m, o_custkey % 33 AS d, year(o_orderdate) AS y FROM orders)
    SELECT record_id, list_distinct(list_filter([CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN y::VARCHAR || '-' || m::VARCHAR || '-' || d::VARCHAR END,
        CASE WHEN d BETWEEN 1 AND 12 AND m BETWEEN 1 AND 31 THEN y::VARCHAR || '-' || d::VARCHAR || '-' || m::VARCHAR END], lambda x: x IS NOT NULL)).list_sort() AS readings
    FROM t WHERE (m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31) OR (d BETWEEN 1 AND 12 AND m BETWEEN 1 AND 31)
""")
def date_candidates(spark, sf_dir):
    """All readings of dates whose month and day may be either way round, or wrong."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet")
    written = F.concat_ws("/", (F.col("o_orderkey") % 14).cast("string"), (F.col("o_custkey") % 33).cast("string"), F.year("o_orderdate").cast("string"))
    found = F.filter(dates.dates(F.concat(written, F.lit("\n"))), lambda d: ~d["partial"])
    readings = lambda d: F.array_sort(F.transform(d["cands"], lambda c: F.concat_ws("-", c["y"], c["m"], c["d"])))
    return own.select(F.col("o_orderkey").alias("record_id"), F.explode(F.transform(found, readings)).alias("readings"))


@query("SELECT o_orderkey AS record_id, (5)::INTEGER AS \"start\", (5 + length((o_orderkey % 15)::VARCHAR) + 5)::INTEGER AS \"end\" FROM orders WHERE o_orderkey % 15 BETWEEN 1 AND 12")
def date_partial(spark, sf_dir):
    """Months with a year alone."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("Seen "), (F.col("o_orderkey") % 15).cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit("\n")).alias("t"))
    found = F.filter(dates.dates(F.col("t")), lambda d: d["partial"])
    return own.select("record_id", F.inline(F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end")))))


@query("""
    WITH t AS (SELECT o_orderkey AS record_id, o_orderkey * 7919 % 90000000 + 10000000 AS n FROM orders), p AS (SELECT *, n // 1000000 AS a, n // 10000 % 100 AS b, n % 100 AS e, n // 100 % 100 AS c FROM t)
    SELECT record_id, 0::INTEGER AS "start", 10::INTEGER AS "end" FROM p
    WHERE NOT ((a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 31) OR (b BETWEEN 1 AND 12 AND a BETWEEN 1 AND 31) OR (c BETWEEN 1 AND 12 AND e BETWEEN 1 AND 31))
""")
def date_suppression_anti(spark, sf_dir):
    """Numbers like those of a criminal record, but for those that are a date."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("A "), (F.col("o_orderkey") * 7919 % 90_000_000 + 10_000_000).cast("string"), F.lit("\n")).alias("t"))
    dated = F.transform(F.filter(dates.dates(F.col("t")), lambda d: ~d["partial"]), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end")))
    return own.select("record_id", F.inline(numbers.bare(F.col("t"), dated, "ncic")))


@query("SELECT o_orderkey AS record_id, 5::INTEGER AS \"start\", 13::INTEGER AS \"end\" FROM orders WHERE o_orderkey % 3 <> 0")
def phone_local(spark, sf_dir):
    """Entered numbers without their area code; every third page has an other one."""
    k = F.col("o_orderkey")
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("record_id"), F.concat(F.lit("call "), F.when(k % 3 == 0, "555-0999").otherwise(F.concat(F.lit("555-"), F.lpad((k % 900).cast("string"), 4, "0"))), F.lit("\n")).alias("t"), F.concat(F.lit("(209) 555-"), F.lpad((k % 900).cast("string"), 4, "0")).alias("entered"))
    return own.select("record_id", F.inline(numbers.phones(F.col("t"), F.array("entered"))))


@query(f"""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 1 END AS hits FROM customer
""")
def common_first_context(spark, sf_dir):
    """A common first name alone: without context, behind a cue, behind a title of providers, near the last name, two lines from it."""
    texts = ["Mary was calm today.", "Patient Mary arrived late.", "Dr. Mary said so.", "Mary was calm.\nBrackwater family", "Mary\nwas\nseen by Brackwater"]
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.element_at(F.lit(texts), (F.col("c_custkey") % 5 + 1).cast("int")).alias("text"))
    who = spark.createDataFrame([(0, "Mary Brackwater", [], "MB", "", [], [], [], [], [])], SUBJECT)
    found = detect.detect(own, who, ("c_custkey",), only=("names",))
    first = F.filter("hits", lambda h: F.substring(F.col("text"), h["start"] + 1, h["end"] - h["start"]) == "Mary")
    return found.select("c_custkey", F.size(first).alias("hits"))


@query(f"""
    WITH c AS (SELECT c_custkey AS {_C} FROM customer) SELECT {_C} AS c_custkey, w.i AS i, w.i <> 2 AS found, w.i < 2 AS exact FROM c, (SELECT unnest(range(0, 4)) AS i) w
""")
def name_best_match(spark, sf_dir):
    """Words against a name: both its parts, an other word, and a damaged part that is still closest to it."""
    c = F.col("c_custkey")
    own = spark.read.parquet(f"{sf_dir}/customer.parquet")
    damaged = F.concat(F.translate(F.substring(F.lower(pages.pick(pages.LAST, c)), 1, 3), "aloi", "4101"), F.substring(F.lower(pages.pick(pages.LAST, c)), 4, 20))
    words = F.array(pages.pick(pages.FIRST, c), F.upper(pages.pick(pages.LAST, c)), F.lit("Zyxt"), damaged)

    @F.pandas_udf("array<struct<found: boolean, exact: boolean>>")
    def codes(full: pd.Series, ws: pd.Series) -> pd.Series:
        return pd.Series([[{"found": (k := names.name_model((n,)).code(w))[0] != ".", "exact": k[1]} for w in own] for n, own in zip(full, ws, strict=True)])

    each = own.select("c_custkey", F.posexplode(codes(F.concat_ws(" ", pages.pick(pages.FIRST, c), pages.pick(pages.LAST, c)), words)).alias("i", "m"))
    return each.select("c_custkey", F.col("i").cast("long").alias("i"), "m.found", "m.exact")


@query(f"""
    WITH c AS (SELECT c_custkey AS {_C}, c_custkey FROM customer)
    SELECT c_custkey, {_NUMBER} AS number, [lower({_pick(pages.STREET, _C)})] AS street, '' AS po_box, [lower({_CITY})] AS city, 'ca' AS state, {_ZIP} AS zip FROM c WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, '', [], {_NUMBER}, [lower({_CITY})], 'ca', {_ZIP} FROM c WHERE c_custkey % 2 = 1
""")
def parse_address(spark, sf_dir):
    """Parts of entered addresses: streets and post boxes."""
    c = F.col("c_custkey")
    part = pages.record_fields(c, c, F.lit("2020-01-01").cast("timestamp"))

    @F.pandas_udf("number string, street array<string>, po_box string, city array<string>, state string, zip string")
    def parsed(s: pd.Series) -> pd.DataFrame:
        found = [addresses.parse_address(x) for x in s]
        return pd.DataFrame({"number": [a.number for a in found], "street": [list(a.street) for a in found], "po_box": [a.po_box for a in found], "city": [list(a.city) for a in found], "state": [a.state for a in found], "zip": [a.zip for a in found]})

    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parsed(F.when(c % 2 == 0, part["address"]).otherwise(part["po_box"])).alias("p")).select("c_custkey", "p.*")


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hits of each category over the records, each page against its subject."""
    return report.counts(_hits(spark, sf_dir))


_DATED = {t: [p[0] for p in parts if not isinstance(p, str) and p[0] in ("dob", "visit", "long_dob", "damaged_dob")] for t, parts in pages.TEMPLATES.items()}


def _date_spans() -> str:
    out = []
    for t, parts in pages.TEMPLATES.items():
        at = "0"
        for p in parts:
            if not isinstance(p, str) and p[0] in _DATED[t]:
                out.append(f"SELECT {_K} AS record_id, {at} AS \"start\", {at} + {'10' if p[0] == 'visit' else f'length({_PARTS[p[0]]})'} AS \"end\" FROM r WHERE kind = '{t}'")
            at = f"{at} + " + (str(len(p)) if isinstance(p, str) else f"length({_PARTS[p[0]]})")
    return " UNION ALL ".join(out)


@query(f"WITH r AS ({_RECORDS}) " + _date_spans())
def date_matches(spark, sf_dir):
    """Whole dates of the records."""

    found = F.filter(dates.dates(text.page_text(F.col("text"))), lambda d: ~d["partial"] & (d["end"] - d["start"] >= 10))
    spans = F.transform(found, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end")))
    return pages.records(spark, sf_dir).select("record_id", F.inline(spans))


@query()
def ocr_distance_pairs(spark, sf_dir):
    """Distinct words of documents within reach of a subject's name, with their distance in tenths. Names meet words of about their length."""
    words = _tokens(spark, sf_dir).select("raw").distinct()
    parts = F.explode(F.split("full_name", " ")).alias("name")
    near_lengths = F.explode(F.sequence(F.length(text.ocr_key(F.col("name"))) - fuzzy.MOST_LONGER, F.length(text.ocr_key(F.col("name"))) + fuzzy.MOST_LONGER)).alias("n")
    entered = pages.subjects(spark, sf_dir).select(parts).distinct().select("name", near_lengths)
    pairs = words.join(entered, F.length(text.ocr_key(F.col("raw"))) == F.col("n")).select("raw", "name")

    @F.pandas_udf("exact boolean, tenths int")
    def near(raw: pd.Series, name: pd.Series) -> pd.DataFrame:
        found = [fuzzy.match(w, n) or (None, None) for w, n in zip(raw, name, strict=True)]
        return pd.DataFrame({"exact": [m[0] for m in found], "tenths": pd.array([m[1] for m in found], "Int32")})

    return pairs.select("raw", "name", near("raw", "name").alias("m")).select("raw", "name", "m.*").where("tenths IS NOT NULL")


def _close_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of damaged records that are redacted as names."""
    damaged = pages.records(spark, sf_dir).withColumn("text", F.translate("text", "AO", "40").cast("string"))
    found = detect.detect(damaged.withColumn("page", F.col("record_id")), pages.subjects(spark, sf_dir), ("page",), "subject_id", ("names",))
    return report.close_forms(found, "page")


_FORMS = f"""
    r AS ({_RECORDS}), w AS (SELECT {_K} AS record_id, unnest(CASE WHEN kind IN ('form', 'table', 'damaged') THEN [upper({_FIRST}), upper({_LAST})] WHEN kind IN ('letter', 'wrapped') THEN [{_FIRST}, {_LAST}] ELSE [] END) AS word FROM r),
    f AS (SELECT translate(word, 'AO', '40') AS form, record_id FROM w WHERE translate(word, 'AO', '40') <> word AND word <> 'BARNABAS')
"""


@query(f"WITH {_FORMS} SELECT form, count(*) AS count, list_sort(list(record_id)) AS pages FROM f GROUP BY 1 ORDER BY 2 DESC LIMIT 20")
def close_forms_topk(spark, sf_dir):
    """The first 20 words of damaged records that are redacted as names, by count; three damaged letters of BARNABAS are too many."""
    return _close_forms(spark, sf_dir).limit(20)


def _shortened(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE regexp_replace(substr({s}, 1, {n}), ',[^,]*$', '') || ', …' END"


def _ranges(table: str, by: str = "1") -> str:
    """SQL of `by` and ranges of `table` (by, page, distinct; at most SHOWN_PAGES pages of each)."""
    return f"""(SELECT k, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '–' || b::VARCHAR END, ', ' ORDER BY a) AS ranges FROM
        (SELECT k, min(page) AS a, max(page) AS b FROM (SELECT {by} AS k, page, page - row_number() OVER (PARTITION BY {by} ORDER BY page) AS island FROM {table}) GROUP BY k, island) GROUP BY k)"""


@query(f"""
    WITH {_FORMS}, h AS ({_HITS}), low AS (SELECT {_K} AS page FROM r WHERE kind = 'fax' ORDER BY 1 LIMIT {report.SHOWN_PAGES}), blank AS (SELECT {_K} AS page FROM r WHERE kind = 'empty' ORDER BY 1 LIMIT {report.SHOWN_PAGES}),
    low_ranges AS (SELECT * FROM {_ranges("low")}), blank_ranges AS (SELECT * FROM {_ranges("blank")}), cats AS (SELECT unnest([{", ".join(repr(c) for c in CATEGORIES)}]) AS cat, unnest([{", ".join(_literal(x) for x in CATEGORIES.values())}]) AS label, unnest(range(0, 9)) AS sort_no),
    counted AS (SELECT sort_no, label, count(h.cat) AS n FROM cats LEFT JOIN h USING (cat) GROUP BY 1, 2), forms AS (SELECT form, count(*) AS n FROM f GROUP BY 1), form_pages AS (SELECT form, record_id AS page FROM f),
    top AS (SELECT form, n, row_number() OVER (ORDER BY n DESC, form) AS k FROM forms)
    SELECT 0 AS line_no, 'title' AS section, 'Exceptions report' AS text, true AS bold UNION ALL SELECT 1, 'title', 'Confidential: it lists forms of names that were redacted.', true
    UNION ALL SELECT 2, 'file', 'File: records', false UNION ALL SELECT 3, 'file', 'Pages: ' || (SELECT count(*) FROM r)::VARCHAR, false UNION ALL SELECT 8, 'low text', 'Pages with very little text', true
    UNION ALL SELECT 9, 'low text', coalesce((SELECT (SELECT count(*) FROM r WHERE kind = 'fax')::VARCHAR || ' page(s): ' || {_shortened("ranges", 600)} FROM low_ranges), 'None.'), false
    UNION ALL SELECT 10, 'low text', 'Blank pages: ' || {_shortened("ranges", 300)}, false FROM blank_ranges UNION ALL SELECT 11, 'counts', 'Redactions by category', true
    UNION ALL SELECT (sort_no + 20)::INTEGER, 'counts', label || ': ' || n::VARCHAR, false FROM counted UNION ALL SELECT 39, 'counts', 'Total: ' || sum(n)::VARCHAR, true FROM counted
    UNION ALL SELECT 40, 'close forms', 'Forms of names that aren''t on the list', true
    UNION ALL SELECT (top.k + 40)::INTEGER, 'close forms', '"' || top.form || '": ' || n::VARCHAR || CASE WHEN n = 1 THEN ' on page ' ELSE ' on pages ' END || {_shortened("ranges", 80)}, false FROM top JOIN {_ranges("form_pages", "form")} g ON g.k = top.form WHERE top.k <= 20
    UNION ALL SELECT 100000, 'close forms', CASE WHEN count(*) = 0 THEN 'None.' ELSE '…and ' || (count(*) - 20)::VARCHAR || ' more' END, false FROM forms HAVING count(*) > 20 OR count(*) = 0
""")
def report_lines(spark, sf_dir):
    """The exceptions report of all records: hits of the records as they are, close forms of damaged ones."""
    run = report.run_statistics(gate.checked(pages.records(spark, sf_dir), F.lit(0.0)), "record_id", "records")
    return report.report_lines(run, report.counts(_hits(spark, sf_dir)), _close_forms(spark, sf_dir))


_BOX = "array(l_partkey % 50, l_suppkey % 20, l_partkey % 50 + l_quantity, l_suppkey % 20 + 12)"


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 20)::DOUBLE AS y0, (l_partkey % 50 + l_quantity)::DOUBLE AS x1, (l_suppkey % 20 + 12)::DOUBLE AS y1 FROM lineitem),
    p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, a.x1 - a.x0 AS aw, b.x1 - b.x0 AS bw FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
    SELECT l_orderkey, i, j FROM p WHERE h >= 0.6 * 12 AND w > 0 AND w * h / greatest(1e-6, least(aw * 12, bw * 12)) >= 0.5
""")
def same_spot(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    box = F.transform(F.expr(_BOX.replace("l_quantity", "cast(l_quantity AS double)")), lambda x: x.cast("double"))
    a = own.select("l_orderkey", F.col("l_linenumber").alias("i"), box.alias("a"))
    b = own.select("l_orderkey", F.col("l_linenumber").alias("j"), box.alias("b"))
    return a.join(b, "l_orderkey").where((F.col("i") < F.col("j")) & boxes.same_spot(F.col("a"), F.col("b"))).select("l_orderkey", "i", "j")


@query()
def box_dedupe(spark, sf_dir):
    """Groups of boxes without those of duplicate layers."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    box = F.transform(F.expr(_BOX.replace("l_quantity", "cast(l_quantity AS double)")), lambda x: x.cast("double"))
    group = F.struct("l_linenumber", F.struct(F.when(F.col("l_suppkey") % 2 == 0, "name").otherwise("account").alias("cat"), F.lit("OB").alias("initials"), F.array(box).alias("rects")).alias("g"))
    groups = own.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(group)).alias("groups"))
    return groups.select("l_orderkey", F.size("groups").alias("before"), F.size(boxes.deduped(F.col("groups.g"))).alias("after"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 50 + l_quantity > 79.5 OR l_suppkey % 20 + 12 > 29.5 OR l_partkey % 50 + l_quantity < 0.5 THEN 4 ELSE 0 END AS boxes FROM lineitem")
def outside_page(spark, sf_dir):
    """Boxes around pages of 80 by 30 that have a character whose far edge lies beyond theirs."""
    rect = F.array(*[F.expr(x).cast("double") for x in ("l_partkey % 50 + l_quantity", "l_suppkey % 20 + 12", "l_partkey % 50 + l_quantity", "l_suppkey % 20 + 12")])
    found = boxes.outside(F.array(rect), F.array(*map(F.lit, (0.0, 0.0, 80.0, 30.0))))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.size(found).alias("boxes"))


@query(f"""
    WITH r AS ({_RECORDS}) SELECT {_K} AS record_id, 50::DOUBLE - 2.4::DOUBLE AS x0, 48::DOUBLE - 0.48::DOUBLE AS y0, (50 + 6 * 11)::DOUBLE + 2.4::DOUBLE AS x1, 60::DOUBLE + 0.48::DOUBLE AS y1 FROM r WHERE kind = 'form'
""")
def span_boxes(spark, sf_dir):
    """The padded box of the Social Security number in each form."""
    own = pages.records(spark, sf_dir).join(_hits(spark, sf_dir, ("ssn",), "form"), "record_id")
    page = text.page_text(F.col("text"))
    rect = F.get(boxes.text_rects(page, text.lines(F.col("text")), F.col("start"), F.col("end")), F.lit(0))
    return own.select("record_id", *[F.get(rect, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


_QUAD = "array(x, y, x + w, y, x, y + h, x + w, y + h)"


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 20)::DOUBLE AS y, l_quantity::DOUBLE AS w, (l_linenumber + 9)::DOUBLE AS h FROM lineitem WHERE l_linenumber <= 3),
    b AS (SELECT l_orderkey, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, avg(h) AS m FROM t GROUP BY 1)
    SELECT l_orderkey, x0 - greatest(1, 0.2 * m) AS x0, y0 - greatest(0.3, 0.04 * m) AS y0, x1 + greatest(1, 0.2 * m) AS x1, y1 + greatest(0.3, 0.04 * m) AS y1 FROM b
""")
def rect_bounds(spark, sf_dir):
    """The padded box of a span of up to three characters with places of their own, and one without."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 3")
    each = own.selectExpr("l_orderkey", "l_linenumber", "cast(l_partkey % 50 AS double) x", "cast(l_suppkey % 20 AS double) y", "cast(l_quantity AS double) w", "cast(l_linenumber + 9 AS double) h")
    lists = each.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr(_QUAD).alias("q")))).alias("own"))
    quads = F.concat(F.array(F.lit(None).cast("array<double>")), F.transform("own", lambda c: c["q"]))
    page = F.concat(F.repeat(F.lit("x"), F.size(quads)), F.lit("\n"))
    rect = F.get(boxes.quad_rects(page, text.lines(page), quads, F.lit(0), F.size(quads)), F.lit(0))
    return lists.select("l_orderkey", *[F.get(rect, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("""
    WITH t AS (SELECT c_custkey, c_custkey % 4 AS p, (c_custkey % 2 = 0)::INTEGER + (c_custkey % 3 = 0)::INTEGER AS off_here, (c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS any_off FROM customer)
    SELECT c_custkey, any_off AND CASE p WHEN 0 THEN off_here = 2 WHEN 1 THEN off_here > 0 WHEN 2 THEN off_here = 0 ELSE off_here < 2 END AS hidden FROM t
""")
def layer_visibility(spark, sf_dir):
    """Content of two layers under each policy, with those layers off or on, or an other one off."""
    k = F.col("c_custkey")
    off = F.array_compact(F.array(F.when(k % 2 == 0, "a"), F.when(k % 3 == 0, "b"), F.when(k % 5 == 0, "c")))
    policy = F.element_at(F.lit(["AnyOn", "AllOn", "AnyOff", "AllOff"]), (k % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", gate.hidden(F.lit(["a", "b"]), policy, off).alias("hidden"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'keep  end' ELSE 'keep gone end' END AS shown FROM customer")
def hidden_layers(spark, sf_dir):
    """Texts without their parts that belong to layers that are off."""
    part = F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit(["a"]).alias("groups"), F.lit("AnyOn").alias("policy"))
    off = F.when(F.col("c_custkey") % 2 == 0, F.lit(["a"])).otherwise(F.lit(["b"]))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", gate.visible(F.lit("keep gone end"), F.array(part), off).alias("shown"))


@query("SELECT c_custkey, list_sort(CASE WHEN c_custkey % 3 = 0 THEN ['Type', 'Contents'] ELSE ['Type', 'Contents', 'B', 'LastModifiedBy'] END || CASE WHEN c_custkey % 2 = 0 THEN ['Title'] WHEN c_custkey % 3 = 0 THEN [] ELSE ['Annots'] END || CASE WHEN c_custkey % 3 = 0 THEN ['LastModifiedBy'] ELSE [] END) AS kept, ['Type'] AS allowed FROM customer")
def metadata_drop(spark, sf_dir):
    """Metadata of pages and of other objects, and what a catalogue keeps of it."""
    k = F.col("c_custkey")
    x = F.lit("x")
    keys = F.create_map(
        F.lit("Type"), F.when(k % 3 == 0, "Page").otherwise("XObject"), F.lit("Metadata"), x, F.when(k % 2 == 0, "Title").otherwise("Annots"), x, F.lit("OC"), x, F.lit("StructParent"), x, F.lit("B"), x, F.lit("Contents"), x,
        F.lit("LastModified"), x, F.lit("LastModifiedBy"), x,
    )
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_sort(F.map_keys(gate.stripped(keys))).alias("kept"), F.map_keys(gate.allowed(keys)).alias("allowed"))


@query("SELECT q::INTEGER AS q, q::INTEGER AS estimate FROM range(50, 96) t(q)")
def jpeg_quality(spark, sf_dir):
    """Headers of JPEG files of each quality, and what is read from them."""
    made = [(q, bytearray(b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(jpeg.TABLES[q - 10].astype(int).tolist()))) for q in range(50, 96)]
    return spark.createDataFrame(made, "q int, data binary").select("q", jpeg.jpeg_quality("data").alias("estimate"))


# PDF bytes and images.


@query("""
    SELECT n_nationkey, '/Span BMC  (' || n_name || ') Tj EMC' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' /OC BMC  (layer) Tj EMC' END || ' BI /W 1 ID EMC EI Q' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' /X1 Do' END AS content FROM nation
""")
def hidden_content(spark, sf_dir):
    """Content streams without hidden layers and objects, and without properties of marks; blanks before what goes are counted as one."""
    own = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text_of = F.concat(F.lit("/Span <</MCID 3/ActualText(a\\)EMC)>> BDC ("), "n_name", F.lit(") Tj EMC /OC /L1 BDC (layer) Tj EMC BI /W 1 ID EMC EI Q /X1 Do"))
    even, third = F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 3 == 0
    none = F.array().cast("array<string>")
    streams = own.select("n_nationkey", F.encode(text_of, "ISO-8859-1").alias("content"), F.when(even, F.array(F.lit("L1"))).otherwise(none).alias("hidden_properties"), F.when(third, F.array(F.lit("X1"))).otherwise(none).alias("hidden_objects"))
    done = assembly.without_hidden(streams, ("n_nationkey",))
    return done.select("n_nationkey", F.rtrim(F.regexp_replace(F.decode("content", "ISO-8859-1"), "EMC +BI", "EMC BI")).alias("content"))


@query("""
    SELECT n_regionkey AS file, count(*) AS pages, (3 * count(*) + 2)::BIGINT AS objects, list(n_nationkey ORDER BY n_nationkey) AS page_order, list((3 * k + 3)::BIGINT ORDER BY k) AS page_numbers
    FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation) GROUP BY 1
""")
def pdf_assembled(spark, sf_dir):
    """Files of one page a nation, joined by region and read again."""
    body = [
        "1 0 obj\n<</Type/Catalog/Pages 2 0 R/Info 7 0 R>>\nendobj\n", "2 0 obj\n<</Type/Pages/Count 1/Kids[3 0 R]>>\nendobj\n", "3 0 obj\n<</Type/Page/Parent 2 0 R/Contents 4 0 R/Gone 9 0 R/Note(see 4 0 R)/Key %KEY%>>\nendobj\n",
        "4 0 obj\n<</Length 5 0 R>>\nstream\nendobj trailer\nendstream\nendobj\n", "5 0 obj\n14\nendobj\n", "7 0 obj\n<</Title(t)>>\nendobj\n", "xref\n0 1\n0000000000 65535 f \ntrailer\n<</Root 1 0 R/Info 7 0 R>>\nstartxref\n0\n%%EOF\n",
    ]
    text_of = F.replace(F.lit("%PDF-1.7\n" + "".join(body)), F.lit("%KEY%"), F.col("n_nationkey").cast("string"))
    parts = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("file"), F.col("n_nationkey").alias("part"), F.encode(text_of, "ISO-8859-1").alias("content"))
    again = assembly.objects(assembly.whole(assembly.assembled(parts)).select("file", F.lit(0).alias("part"), "content"))
    page = F.when(F.col("kind") == "page", F.struct("page", "number", F.regexp_extract(F.decode("body", "ISO-8859-1"), r"/Gone null/Note\(see 4 0 R\)/Key ([0-9]+)", 1).cast("long").alias("key")))
    pages_of = again.groupBy("file").agg(F.count("page").alias("pages"), F.count("*").alias("objects"), F.array_sort(F.collect_list(page)).alias("own"))
    return pages_of.select("file", "pages", "objects", F.col("own.key").alias("page_order"), F.col("own.number").alias("page_numbers"))


_IMAGE = "array(cast(32 AS double), cast(0 AS double), cast(0 AS double), cast(16 AS double), cast(l_partkey % 50 AS double), cast(l_suppkey % 20 AS double))"


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 50)::DOUBLE AS x, (l_suppkey % 20)::DOUBLE AS y FROM lineitem), r AS (SELECT *, (30 - x) / 32 AS u0, (12 - y) / 16 AS v0, (44 - x) / 32 AS u1, (25 - y) / 16 AS v1 FROM t WHERE x < 44 AND x + 32 > 30 AND y < 25 AND y + 16 > 12)
    SELECT l_orderkey, l_linenumber, greatest(0, floor(u0 * 80) - 1)::INTEGER AS x0, greatest(0, floor(v0 * 60) - 1)::INTEGER AS y0, least(80, ceil(u1 * 80) + 1)::INTEGER AS x1, least(60, ceil(v1 * 60) + 1)::INTEGER AS y1 FROM r
""")
def image_regions(spark, sf_dir):
    """Pixels of images of 80 by 60 that a box on their page covers."""
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr(_IMAGE).alias("matrix"), F.lit(80).alias("width"), F.lit(60).alias("height"))
    box = own.select("l_orderkey").distinct().withColumn("rects", F.array(F.array(*map(F.lit, (30.0, 12.0, 44.0, 25.0)))))
    return images.covered(own, box, ("l_orderkey",)).select("l_orderkey", "l_linenumber", F.inline("regions"))


@query("""
    SELECT p_partkey, p_partkey % 5 <> 0 AS done, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 16 * 8 - 6 * 4 ELSE (16 * 8 - 6 * 4) * 3 END AS white FROM part
""")
def image_fill(spark, sf_dir):
    """White samples left of white images (of one bit, or deflated colours) whose region is blackened; every fifth can't be rewritten."""
    k = F.col("p_partkey")

    @F.pandas_udf("binary")
    def white(key: pd.Series) -> pd.Series:
        return key.map(lambda n: b"\xff" * 16 if n % 2 == 0 else zlib.compress(b"\xff" * (16 * 8 * 3)))

    @F.pandas_udf("long")
    def count(data: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else sum(x.bit_count() for x in d) if n % 2 == 0 else zlib.decompress(d).count(b"\xff") for d, n in zip(data, key, strict=True)], dtype="Int64")

    even, region = k % 2 == 0, F.expr("array(named_struct('x0', 3, 'y0', 2, 'x1', 9, 'y1', 6))")
    made = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", white(k).alias("data"), F.when(even, "").otherwise("FlateDecode").alias("filter"), F.lit(16).alias("width"), F.lit(8).alias("height"), F.when(even, 1).otherwise(3).alias("components"),
        F.when(even, 1).otherwise(8).alias("bits"), region.alias("regions"), (k % 5 == 0).alias("fallback"),
    )
    return images.blackened(made, ("p_partkey",)).select("p_partkey", "done", count("data", k).alias("white"))


@query("SELECT 'phone' AS cat, count(*) AS n FROM (SELECT * FROM events WHERE event_type = 'click')")
def stream_counts(spark, sf_dir):
    """Events as a stream of pages, each click with a protected phone, redacted and counted as they come."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    who = spark.createDataFrame([(0, "Ottoline Brackwater", [], "OB", "", [], ["(838) 555-7235"], [], [], [])], SUBJECT)
    page = F.concat(F.lit("event "), "event_type", F.when(F.col("event_type") == "click", F.lit(" call 838.555.7235")).otherwise(""))
    counts = redacted_at_once(sf_dir, "events*.parquet", schema, lambda df: df.select("event_id", page.alias("text")), who, ("event_id",))
    return counts.groupBy("cat").agg(F.sum("n").alias("n")).where("n > 0")


__all__ = ["ORACLE_SQL", "QUERIES", "entry_query"]

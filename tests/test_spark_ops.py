"""Expressions and plans, against plain Python or SQL on a small table."""

import math
import os
import random
import re
import time
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkveil import queries as engine
from inkveil.functions import dates, numbers
from inkveil.functions import text as T
from inkveil.functions.names import name_model
from inkveil.functions.words import Words
from inkveil.operators import boxes, detect, gate, report, spans
from inkveil.plans.redaction import redact
from inkveil.sources import pages
from inkveil.streaming.stream import Progress, read_pages, redact_stream

SF = "/root/testdata/sf0.001"


def one(spark, *values_and_expr):
    *values, expr = values_and_expr
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values)))).select(expr).first()[0]


def test_find_all_overlaps(spark):
    pattern = r"(?<![\p{L}\p{N}])[0-9]+(?: [0-9]+)?"
    got = one(spark, "a 12 34 567 é 8", T.find_all(F.col("c0"), pattern))
    assert [(r.start, r.end, r.s) for r in got] == [(2, 7, "12 34"), (5, 11, "34 567"), (8, 11, "567"), (14, 15, "8")]
    assert one(spark, "no digits", T.find_all(F.col("c0"), pattern)) == []
    assert one(spark, "", T.find_all(F.col("c0"), pattern)) == []


def test_lines_and_folding(spark):
    assert [(r.start, r.end) for r in one(spark, "ab\n\nc", T.lines(F.col("c0")))] == [(0, 2), (3, 3), (4, 5)]
    assert one(spark, "O'Brién's", T.fold(F.col("c0"))) == "obrien"
    assert one(spark, "Srnith1", T.ocr_key(F.col("c0"))) == "smithl"


def _merged(spark, hits):
    df = spark.createDataFrame([(hits,)], "hits array<struct<cat:string,start:int,end:int,ord:int,initials:string>>")
    return [(r.cat, r.start, r.end, r.initials) for r in df.select(spans.merged(F.col("hits"))).first()[0]]


def test_merge(spark):
    assert _merged(spark, []) == []
    assert _merged(spark, [("name", 5, 9, 0, "OB"), ("ssn", 9, 12, 1, None), ("name", 0, 6, 2, "OB"), ("dob", 20, 20, 3, None)]) == [("name", 0, 9, "OB"), ("ssn", 9, 12, None)]
    assert _merged(spark, [("name", 0, 6, 0, "OB"), ("address", 4, 9, 1, None), ("phone", 8, 10, 2, None)]) == [("address", 0, 10, None)]


def test_redacted(spark):
    df = spark.createDataFrame([("é Ann and 123.", [("name", 2, 5, "A"), ("ssn", 10, 13, None)])], "t string, m array<struct<cat:string,start:int,end:int,initials:string>>")
    assert df.select(spans.redacted(F.col("t"), F.col("m"))).first()[0] == "é [A] and [SSN]."


def test_page_ranges(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 9, 10],), ([],), ([4],)], "p array<int>")
    assert [r[0] for r in df.select(report.page_ranges(F.col("p"))).collect()] == ["1–3, 7, 9–10", "", "4"]


def plain_same_spot(a, b):
    w, h = (min(a[k + 2], b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return h >= 0.6 * min(a[3] - a[1], b[3] - b[1]) and w > 0 and h > 0 and w * h >= 0.5 * min(area(a), area(b))


def random_boxes(seed, n):
    rng = random.Random(seed)
    corners = [(10.0 * rng.randrange(4) + rng.random(), 12.0 * rng.randrange(3) + rng.random()) for _ in range(n)]
    return [[x, y, x + rng.choice((20.0, 24.0)), y + rng.choice((10.0, 11.0))] for x, y in corners]


def test_boxes_against_brute_force(spark):
    """Duplicates, and boxes on one spot, in many random groups."""
    rows, want = [], []
    for seed in range(25):
        rects = random_boxes(seed, 9)
        groups = [("name" if k % 3 else "ssn", "AB" if k % 3 else None, rects[3 * k : 3 * k + 1 + k % 3]) for k in range(3)]
        own = [{"rect": r, "initials": "AB" if k % 2 else None} for k, r in enumerate(rects)]
        rows.append((seed, groups, [(b["rect"], b["initials"]) for b in own]))
        kept = []
        for cat, _, rs in groups:
            dup = next((o for o in kept if o[0] == cat and rs and all(any(plain_same_spot(r, q) for q in o[1]) for r in rs)), None)
            dup[1].extend(rs) if dup else kept.append((cat, list(rs)))
        while pair := next(((i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if (own[i]["initials"] is None) == (own[j]["initials"] is None) and plain_same_spot(own[i]["rect"], own[j]["rect"])), None):
            a, b = own[pair[0]]["rect"], own.pop(pair[1])["rect"]
            own[pair[0]]["rect"] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
        want.append((kept, [(b["rect"], b["initials"]) for b in own]))
    df = spark.createDataFrame(rows, f"k int, g {boxes.GROUPS}, b {boxes.BOXES}")
    got = df.orderBy("k").select(boxes.deduped(F.col("g")).alias("g"), boxes.united(F.col("b")).alias("b")).collect()
    for r, (kept, united) in zip(got, want, strict=True):
        assert [(g.cat, g.rects) for g in r.g] == kept and [(b.rect, b.initials) for b in r.b] == united


def test_text_and_quad_rects_agree(spark):
    page = "ab cd\n  ef  \n\n"
    quad = lambda i, k: [20.0 + 6 * k, 20.0 + 14 * i, 26.0 + 6 * k, 20.0 + 14 * i, 20.0 + 6 * k, 32.0 + 14 * i, 26.0 + 6 * k, 32.0 + 14 * i]
    quads = [q for i, line in enumerate(page.split("\n")[:-1]) for q in [*(quad(i, k) for k in range(len(line))), None]]
    df = spark.createDataFrame([(page, quads, 1, 12), (page, quads, 5, 8), (page, quads, 0, 2)], "t string, q array<array<double>>, a int, b int")
    own = T.lines(F.substring("t", F.lit(1), F.length("t") - 1))
    got = df.select(boxes.text_rects(F.col("t"), own, F.col("a"), F.col("b")), boxes.quad_rects(F.col("t"), own, F.col("q"), F.col("a"), F.col("b"))).collect()
    assert got[0][0] == [pytest.approx([23.6, 19.52, 52.4, 32.48]), pytest.approx([29.6, 33.52, 46.4, 46.48])] and got[1][0] == []
    for text, by_quad in got:
        assert [pytest.approx(r) for r in text] == by_quad


def test_layout_of_initials(spark):
    r = spark.range(1).select(boxes.initials_layout(F.array(*map(F.lit, (10.0, 20.0, 50.0, 30.0))), F.lit(2.0)).alias("l"), *[boxes.short_number(F.lit(x)) for x in (1.5, 2.0, -0.00001, 0.12345)]).first()
    assert (r.l["size"], r.l.x) == (8.5, 21.5) and math.isclose(r.l.y, 25 + 0.716 * 8.5 / 2) and list(r[1:]) == ["1.5", "2", "0", "0.123"]


WHO = [(0, "Ottoline Brackwater", ["x"], "OB", "", [], [], [], [], [])]


def test_redaction_is_idempotent_and_stops_files(spark, tmp_path):
    rows = [(1, 1, "SSN: 078-45-1120"), (1, 2, "plain"), (2, 1, "SSN: 078-45-1120"), (2, 2, ""), (2, 3, " \n"), (3, 1, None), (3, 2, "seen Brackwater")]
    df = spark.createDataFrame(rows, "file long, page long, text string")
    who = spark.createDataFrame(WHO, engine.SUBJECT)
    done = redact(df, who, ("file", "page"), file="file", page_no="page", store=str(tmp_path / "found"))
    assert [(r.file, r.pages) for r in done.blocked.orderBy("file").collect()] == [(2, [2, 3]), (3, [1])]
    assert {(r.file, r.page): r.redacted for r in done.pages.collect()} == {(1, 1): "SSN: [SSN]", (1, 2): "plain"}
    assert {r.cat: r.n for r in done.counts.collect() if r.n} == {"ssn": 1}
    stats = {r.file: r for r in done.stats.collect()}
    assert [stats[k].status for k in (1, 2, 3)] == ["ok", "blocked", "blocked"] and (stats[1].page_count, stats[1].redactions, stats[1].low_text_pages) == (2, 1, 2)
    blank = redact(df, who, ("file", "page"), file="file", page_no="page", dark_share=F.when(F.col("file") == 2, 0.0005))
    assert [r.file for r in blank.blocked.collect()] == [3]
    first = {(r.file, r.page): r.redacted for r in blank.pages.collect()}
    again = redact(blank.pages.select("file", "page", F.col("redacted").alias("text")), who, ("file", "page"), dark_share=F.lit(0.0))
    assert set(first) == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)} and first == {(r.file, r.page): r.redacted for r in again.pages.collect()}


def test_layers_of_a_page_count_once_and_fields_are_text(spark):
    rows = [(1, 0, "seen Brackwater", [("Name", "Ottoline Brackwater"), ("Void", None)]), (1, 1, "seen Brackwater", []), (2, 0, "seen Brackwater", None)]
    df = spark.createDataFrame(rows, "page long, layer int, text string, fields array<struct<name:string,value:string>>")
    done = redact(df, spark.createDataFrame(WHO, engine.SUBJECT), ("page", "layer"), fields="fields", layer="layer")
    assert {r.cat: r.n for r in done.counts.collect() if r.n} == {"name": 3}
    assert {r.page: [b.initials for b in r.boxes] for r in done.boxes.collect()} == {1: ["OB", "OB"], 2: ["OB"]}
    assert {(r.page, r.layer): r.redacted for r in done.pages.collect()}[1, 0] == "seen [OB]\nName: [OB]"


def test_gate_refuses_what_is_missing(spark):
    col = lambda v, t="string": F.lit(v).cast(t)
    got = spark.range(1).select(gate.problems(col(None), col(None, "array<string>"), col(None), col(None), col(None), col(None, "long"))).first()[0]
    assert got == ["no file", "no name", "no variant", "no initials"]
    got = spark.range(1).select(gate.problems(col("A B"), F.array(F.lit("A")), col("AB"), col("April 23, 1981"), col("x.PDF"), col(1, "long"))).first()[0]
    assert got == []


def test_stream(spark, tmp_path):
    spark.createDataFrame([(k, "SSN: 078-05-1120") for k in range(10)], "k long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    who = spark.createDataFrame([(0, "Ottoline Brackwater", ["x"], "OB", "", [], [], [], [], [])], engine.SUBJECT)
    stream = spark.readStream.schema("k long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    redact_stream(stream, who, ("k",), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/pages")).where("redacted = 'SSN: [SSN]'").count() == 10
    assert spark.read.parquet(str(tmp_path / "out/counts")).where("cat = 'ssn'").agg(F.sum("n")).first()[0] == 10


def test_stream_hooks(spark, tmp_path):
    spark.createDataFrame([(k, "call Brackwater") for k in range(6)], "k long, text string").repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = read_pages(spark, str(tmp_path / "in"), "k long, text string")
    redact_stream(stream, spark.createDataFrame(WHO, engine.SUBJECT), ("k",), str(tmp_path / "out"), after=lambda df, n: seen.append((n, df.count()))).awaitTermination()
    assert sorted(n for n, _ in seen) == [0, 1] and sum(c for _, c in seen) == 6


def test_progress_is_told_seldom():
    told = []
    listener = Progress(lambda *x: told.append(x), rows=10)
    listener.onQueryStarted(None)
    for k, n in enumerate((4, 4, 4, 20, 1)):
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(batchId=k, numInputRows=n)))
    assert told == [(2, 4, 12), (3, 20, 32)]


def test_files(spark, tmp_path):
    locked = b"%PDF-1.7 /Encrypted words 1 0 obj endobj trailer <</Size 3 /Encrypt 3 0 R>>"
    for name, data in (("a.pdf", b"%PDF-1.7 says /Encrypt 3 times, no trailer"), ("b.pdf", b"hello"), ("c.pdf", locked), ("e.pdf", b"%PDF" + b"x" * 500)):
        (tmp_path / name).write_bytes(data)
    good, bad = pages.files(spark, str(tmp_path), most_bytes=200)
    assert [r.name for r in good.collect()] == ["a.pdf"]
    assert {r.name: r.reason for r in bad.collect()} == {"b.pdf": "not a PDF", "c.pdf": "needs a password", "e.pdf": "too large"}


def test_page_numbers_across_pieces(spark):
    df = spark.createDataFrame([(f, f * 1000 + k * 7) for f in range(3) for k in range(50)], "file long, doc_id long").repartition(4)
    got = {(r.file, r.doc_id): r.page_no for r in pages.page_numbers(df, "file", "doc_id", piece=64).collect()}
    assert got == {(f, f * 1000 + k * 7): k + 1 for f in range(3) for k in range(50)}


def test_entry(spark):
    assert entry.entry(spark).count() == 9


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_queries_fit_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(f"SELECT * FROM ({engine.ORACLE_SQL[name]}) q").to_arrow_table()
    got = engine.QUERIES[name](spark, SF).toArrow()
    assert sorted(want.column_names) == sorted(got.column_names)
    rows = lambda t: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in zip(*(t.column(c).to_pylist() for c in sorted(t.column_names)), strict=True))
    assert [re.sub(r"\b(\d+)\.0\b", r"\1", x) for x in rows(want)] == [re.sub(r"\b(\d+)\.0\b", r"\1", x) for x in rows(got)]


def test_close_forms_are_of_all_records(spark):
    """Counted by the words of every damaged page in plain Python."""
    found = engine._close_forms(spark, SF).collect()
    seen: dict = {}
    who = {r.subject_id: name_model((r.full_name,)) for r in pages.subjects(spark, SF).collect()}
    for r in pages.records(spark, SF).collect():
        for form in who[r.subject_id].find(Words(r.text.translate(str.maketrans("AO", "40")) + "\n"))[1] if r.subject_id in who else ():
            seen.setdefault(form, []).append(r.record_id)
    assert any(p % 3 for own in seen.values() for p in own)
    assert {r.form: (r["count"], r.pages) for r in found} == {f: (len(p), sorted(set(p))) for f, p in seen.items()}
    assert [r["count"] for r in found] == sorted(map(len, seen.values()), reverse=True)


def test_report_tells_of_forms_beyond_its_lines(spark):
    forms = spark.createDataFrame([(f"F0RM{k:02}", 100 - k, [1, 2] if k else [5]) for k in range(25)], "form string, count long, pages array<long>")
    checked = gate.checked(spark.createDataFrame([(k, "" if k % 4 == 0 else "few words" if k % 4 == 1 else "many words " * 9) for k in range(40)], "page long, text string"), F.lit(0.0))
    run = report.run_statistics(checked, "page", "x.pdf").withColumns({"input_bytes": F.lit(3 << 20), "output_bytes": F.lit(1 << 19), "elapsed_ms": F.lit(1234), "version": F.lit("1"), "fields_flattened": F.lit(True)})
    counted = report.counts(spark.createDataFrame([("ssn",)] * 3, "cat string"))
    got = {}
    for r in report.report_lines(run, counted, forms).orderBy("line_no").collect():
        got.setdefault(r.section, []).append(r.text)
    assert got["close forms"][1:] == ['"F0RM00": 100 on page 5', *(f'"F0RM{k:02}": {100 - k} on pages 1–2' for k in range(1, 20)), "…and 5 more"]
    assert got["file"] == ["File: x.pdf", "Pages: 40   Version: 1", "Input 3.0 MB, output 0.5 MB, time 1.2 s", "Form fields became text before redaction."]
    assert got["low text"][1:] == ["10 page(s): " + ", ".join(map(str, range(1, 40, 4))), "Blank pages: " + ", ".join(map(str, range(0, 40, 4)))] and got["counts"][-1] == "Total: 3"


def test_report_detects_once_for_each_of_its_inputs(spark):
    """Once for the counts, and once for the close forms, which its list and its number of further forms both read."""
    lines = engine.QUERIES["report_lines"](spark, SF)
    lines.collect()
    plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2


def test_ranges_of_very_many_pages(spark):
    """In time that grows with the pages, not with their square."""
    own = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda k: 2 * k + F.when(k % 10 == 0, 1).otherwise(0)).alias("pages"))
    began = time.time()
    (got,) = own.select(report.page_ranges(F.col("pages")).alias("r")).first()
    assert time.time() - began < 30
    want, last = [], None
    for p in (2 * k + (k % 10 == 0) for k in range(1, 60_001)):
        if last and p == last[1] + 1:
            last[1] = p
        else:
            want.append(last := [p, p])
    assert got == ", ".join(str(a) if a == b else f"{a}–{b}" for a, b in want) and any(a < b for a, b in want)
    assert spark.sql("SELECT array() AS p").select(report.page_ranges(F.col("p").cast("array<int>"))).first()[0] == ""


def test_large_profiles_meet_pages_in_one_shuffle(spark):
    """Over more partitions than cores, and with the hits that broadcast profiles give; pages without a subject stay."""
    own = pages.records(spark, SF).limit(400).withColumn("subject_id", F.when(F.col("record_id") % 9 != 0, F.col("subject_id"))).cache()
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(detect.detect(own, pages.subjects(spark, SF), ("record_id",), "subject_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = detect.detect(own, pages.subjects(spark, SF), ("record_id",), "subject_id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
        assert rows(found) == want and len(want) == 400
        joined = detect.with_profiles(own, pages.subjects(spark, SF), ("record_id",), "subject_id")
        assert joined.rdd.getNumPartitions() == detect.SPREAD * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookaheads_pass_over_no_label(spark):
    """Letters outside ASCII that patterns without case take for one in it begin labels and months too."""
    texts = ["ſSN 1", "\u017fsn: 123-45-6789", "ssn SSN", "ınsured id 12345", "İNSURED ID 12345", "insured id", "Born on", "MRN and mrn", "ſept 4, 1980", "x dob Date of Birth", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (numbers.SSN_LABEL, dates.BIRTH_LABEL, dates.MONTH_FIRST, *(p for p, _ in numbers.LABELS.values())):
        plain = re.sub(r"^\(\?=\[[^\]]*\]\)", "", p)
        assert plain != p
        both = df.select("t", T.find_all(F.col("t"), p).alias("a"), T.find_all(F.col("t"), plain).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]

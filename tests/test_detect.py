"""Detectors on pages written with marks: <cat|what is to be found>. All pages go through one plan."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.functions import dates, fuzzy, numbers
from inkveil.functions.addresses import parse_address
from inkveil.functions.names import NameModel, initials_for, parse_name
from inkveil.functions.scan import Page
from inkveil.functions.text import page_text
from inkveil.functions.words import Words
from inkveil.operators import detect, spans
from inkveil.schema import SUBJECT

WHO = (
    7, "Wilhelmina T. Oakenshaw", ["Minna Oakenshaw", "Oakenshaw-Pell, Wilhelmina"], "wo", "12/03/1967", ["88 Larkmoor Bend, Unit 4, Fairhaven, OR 97123", "PO Box 612, Dunmere, OR 97140"],
    ["(541) 555-0182"], ["Barnaby Threlkeld"], ["19 Quarry Road, Dunmere, OR 97140"], ["541 555 0199"],
)

PAGES = {
    "names in order and reversed": "Report on <name|Wilhelmina Oakenshaw>, file of <name|OAKENSHAW, WILHELMINA T.>",
    "a nickname alone": "Then <name|Minna> left",
    "a hyphenated last name, whole or in part": "Signed <name|Wilhelmina Oakenshaw-Pell>; later <name|Pell>",
    "names over one line break": "seen: <name|Wilhelmina\nOakenshaw>\n",
    "a blank line parts names": "<name|Minna>\n\n<name|Oakenshaw>",
    "read badly": "<name|W1lhelmina 0akenshaw> and <name|Oakemshaw>",
    "possessive": "at <name|Oakenshaw's> place",
    "no other names": "Wilma Oakes met Minnie Shaw",
    "initials go with a last name": "<name|W. T. Oakenshaw> but W. T. Other",
    "other people": "with <other|Barnaby Threlkeld> and <other|Threlkeld>",
    "numbers in three groups": "a <ssn|219-45-9999> b <ssn|219 45 9998> c <ssn|2I9-45-999O>; month and year aren't one: 219-09-2010",
    "nine digits": "id <ssn|219099996>",
    "masked numbers": "ends in <ssn|***-**-4321> or <ssn|xxx-xx-4321>",
    "labelled though hardly legible": "Social Security # <ssn|2l9 O9 OO18>",
    "neither money nor dates nor longer numbers": "$219,099.99 on 02-19-2020 12-2190-9999 2190999912",
    "licences": "Driver's license: <dl|K5550123>, DL # <dl|N0123456>",
    "a licence by its form alone": "holds <dl|K7654321> now",
    "criminal records": "CII <ncic|A10203040>, FBI No. <ncic|443 221> 9",
    "behind a label": "MRN# <account|0055-112>; Policy <account|XK 99213 55>",
    "a short number isn't an account": "Claim 12",
    "below a label": "Member        Plan\n<account|7781234>       Gold",
    "below a wrapped label": "Patient\nAccount 04/05/2021\n<account|5550017>",
    "too far to the right": "Invoice No.\n                              88221133",
    "five lines below at most": "Claim\n\n\n\n\n<account|9912345>",
    "not six lines below": "Claim\n\n\n\n\n\n9912345",
    "a time isn't an account": "Visit ID\n1315",
    "birth dates in many forms": "<dob|12/03/1967> <dob|3.12.1967> <dob|1967-12-03> <dob|Dec 3rd, 1967> <dob|3 December 67> <dob|12031967>",
    "a labelled birth date, whatever it is": "D.O.B. <dob|01/02/1950>",
    "a labelled birth date below": "Date of Birth   Sex\n<dob|05-06-1951>      F\n07/08/1952",
    "other dates": "seen 12/04/1967, 1968-12-03",
    "a street": "lives at <address|88 Larkmoor Bend, Unit 4, Fairhaven, OR 97123>.",
    "a street over two lines": "<address|88 Larkmoor Bend #4\nFairhaven Oregon 97123-0001>",
    "a street read badly": "<address|8B Larkrnoor Bend>",
    "an other house": "90 Larkmoor Bend",
    "a post box": "mail: <address|P.O. Box 612, Dunmere> thanks",
    "a city line": "near <address|Fairhaven, OR 97123>",
    "the address of other people": "at <other|19 Quarry Road>",
    "phones": "<phone|(541) 555-0182>, <phone|541.555.0182 ext. 9>, <phone|+1 541-555-0182>, <phone|54l-555-Ol82>",
    "a phone over two lines": "<phone|(541)\n555-0182>",
    "a phone without its area": "dial <phone|555-0182>",
    "other phones": "office (541) 555-0100, theirs <other|541-555-0199>",
    "nothing at all": "The quick brown fox jumps over 13 lazy dogs.",
    "empty": "",
}

_MARK = re.compile(r"<(\w+)\|([^>]*)>")


def wanted(marked):
    plain, out, at = "", [], 0
    for m in _MARK.finditer(marked):
        plain += marked[at : m.start()]
        out.append((m[1], len(plain), len(plain) + len(m[2])))
        plain += m[2]
        at = m.end()
    return plain + marked[at:], out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, wanted(text)[0]) for name, text in PAGES.items()]
    done = detect.detect(spark.createDataFrame(rows, "name string, text string"), spark.createDataFrame([WHO], SUBJECT), ("name",))
    got = done.select("name", "text", spans.merged(done["hits"]).alias("merged"), "close").collect()
    return {r.name: r for r in got}


@pytest.mark.parametrize("name", PAGES)
def test_page(found, name):
    text, want = wanted(PAGES[name])
    got = [(h.cat, h.start, h.end) for h in found[name].merged]
    told = lambda xs: [(c, text[a:b]) for c, a, b in xs]
    assert got == want, (told(got), told(want))


def test_initials_and_close_forms(found):
    assert {h.initials for h in found["names in order and reversed"].merged} == {"WO"}
    assert found["read badly"].close == ["W1lhelmina", "0akenshaw", "Oakemshaw"] and found["other people"].close == []


CONTEXT = {
    "Susan was calm.": 0, "Patient Susan was calm.": 1, "Dr. Susan was calm.": 0, "Susan Park, RN came": 0, "Susan M.D.": 0, "Susan\nor so\nHartwell's case": 2, "Susan\nor\nso\non Hartwell": 1,
    "Dear Susan, hello": 1, "nurse Susan Hartwell": 1,
}


@pytest.mark.parametrize("text", CONTEXT)
def test_common_first_names_need_context(text):
    assert len(NameModel(["Susan Hartwell"]).find(Words(text + "\n"))[0]) == CONTEXT[text]


def test_everyday_words_need_a_capital():
    spans, _ = NameModel(["Ada Brown"]).find(Words("brown bread; Brown bread\n"))
    assert spans == [(13, 18)]
    assert NameModel(["Ada Brown"], everyday=frozenset()).find(Words("brown bread\n"))[0] == [(0, 5)]


def test_entered_names_and_addresses():
    assert parse_name("Oakenshaw,  Wilhelmina T. Jr.") == ("Wilhelmina", ["T."], "Oakenshaw")
    assert parse_name("Minna") == ("Minna", [], "") and parse_name("") == ("", [], "") and initials_for("Oakenshaw, Wilhelmina") == "WO"
    a = parse_address("88 N Larkmoor Bend Rd, Unit 4, Fairhaven, Oregon 97123-0001")
    assert (a.number, a.street, a.unit, a.city, a.state, a.zip) == ("88", ("larkmoor", "bend"), "4", ("fairhaven",), "or", "97123")
    assert parse_address("P.O. Box 612, Dunmere").po_box == "612" and parse_address("7 Elm St #3B").unit == "3b"


def test_one_subject_for_all_pages_must_be_one(spark):
    df, who = spark.createDataFrame([(1, "x")], "k long, text string"), spark.createDataFrame([WHO, WHO], SUBJECT)
    for subjects in (who, who.where("false")):
        with pytest.raises(ValueError, match="one subject"):
            detect.detect(df, subjects, ("k",))


def plain_distance(a, b):
    """The whole table, without limits."""
    cost = [[10 * (i + j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            cost[i][j] = min(cost[i - 1][j] + 10, cost[i][j - 1] + 10, cost[i - 1][j - 1] + (0 if x == y else 4 if fuzzy.confusable(x, y) else 10))
            if i > 1 and j > 1 and a[i - 2] == y and x == b[j - 2]:
                cost[i][j] = min(cost[i][j], cost[i - 2][j - 2] + 10)
    return cost[-1][-1]


@given(st.text("abcdeilmnort0153", max_size=9), st.text("abcdeilmnort0153", max_size=9), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_distance_fits_the_whole_table(a, b, most):
    want = plain_distance(a, b)
    assert fuzzy.distance(a, b, most) == (want if want <= most else None)


@pytest.mark.parametrize("text", ["", "\n\n", "é" * 3000, "1" * 5000, "555 " * 2000, "-" * 4000])
def test_odd_pages_dont_break_words(text):
    words = Words(text)
    assert all(text[a:b] == f for a, b, f in zip(words.starts, words.ends, words.forms, strict=True)) and len(words.lines()) == len(words.forms)


def test_scanned_pages_have_the_spans_of_column_expressions(spark):
    """Numbers, labels and dates put together at random, in part damaged, page by page in Python and by columns; merging and rewriting too."""
    parts = (
        "SSN|ſſn|Social Security No.|DOB:|Born on|bırth date|MRN|Medical\nRecord|Driver's License #:|D.L. 123|CII:|State ID No.|patient id|123-45-6789|l23-45-678O|123456789|XXX-XX-1234|A1234567|A 12345678|"
        "01/02/1960|Ol/O2/l960|2001-05-06|May 5, 2001|5th of May 2001|L5 January 2020|1st ſept 99|05061970|5/1999|1l2l1990x|1/2/1990 1256|(209) 555-1234|+1 209 555 1234 ext. 12|555-1234|12345|$12.00|Zebra|½|Ⅳ|٣٤|\x01|!09 555 1234"
    ).split("|") + ["|2O9 555-1234", "O1|O2|l990 1256", "|"]
    draw = random.Random(5)
    rows = [(k, "".join(draw.choice(parts) + draw.choice((" ", "   ", "\n", "", ", ", "-")) for _ in range(draw.randint(1, 12))), draw.sample(["2095551234", "555-1234", None], 2), draw.choice([None, (1960, 1, 2), (2001, 5, 6)])) for k in range(1500)]
    df = spark.createDataFrame(rows, "k int, text string, phones array<string>, born struct<y:int,m:int,d:int>")
    text, dated = F.col("page"), F.col("dated")
    df = df.withColumn("page", page_text(F.col("text"))).withColumn("dates", dates.dates(text)).withColumn("dated", dates.date_spans(text, F.col("dates")))
    own = {cat: F.concat(numbers.labelled(text, cat), numbers.bare(text, dated, cat)) for cat in ("dl", "ncic")}
    own |= {"ssn": numbers.social_security(text, dated), "account": numbers.labelled(text, "account"), "dob": dates.birth_dates(text, F.col("dates"), F.col("born")), "phones": numbers.phones(text, F.col("phones"))}
    hits = F.array_distinct(F.transform(F.concat(*own.values()), lambda s: F.struct(F.lit("x").alias("cat"), s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("initials"))))
    df = df.withColumn("hits", hits).withColumn("merged", spans.merged(F.col("hits"))).withColumn("redacted", spans.redacted(F.col("text"), F.col("merged")))
    some = dict.fromkeys(own, 0)
    for r in df.select("*", *(c.alias(f"_{n}") for n, c in own.items())).collect():
        page = Page(r.text + "\n")
        got = {cat: page.labelled(cat) + page.bare(cat) for cat in ("dl", "ncic")}
        got |= {"ssn": page.ssn(), "account": page.labelled("account"), "dob": page.births(r.born and tuple(r.born)), "phones": page.phones([x for x in r.phones if x])}
        assert page.dated == [tuple(s) for s in r.dated]
        assert got == {n: [tuple(s) for s in r[f"_{n}"]] for n in own}, r.text
        merged = spans.merged_hits([tuple(h) for h in r.hits])
        assert merged == [tuple(m) for m in r.merged] and spans.redacted_text(r.text, merged) == r.redacted
        for n in own:
            some[n] += len(got[n])
    assert min(some.values()) > 50


def test_detection_has_no_interpreted_columns(spark):
    """Spans of all kinds, merged, and texts are made in the one pass over Arrow batches."""
    who = spark.createDataFrame([WHO], SUBJECT)
    found = detect.detect(spark.createDataFrame([("a", "SSN 123-45-6789")], "name string, text string"), who, ("name",), rewrite=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan.split("MapInArrow")[0] and "lambda" not in plan.split("MapInArrow")[0]
    assert found.first().redacted == "SSN [SSN]"

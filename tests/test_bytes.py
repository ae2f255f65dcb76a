"""Content streams, PDF objects and pixels, on bytes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.functions import content, pdf
from inkveil.operators import images
from inkveil.sources import assembly

STREAMS = [
    (b"/P <</MCID 0>> BDC (x) Tj EMC", b"/P BMC  (x) Tj EMC"),
    (b"q /OC /a BDC 1 0 0 rg /OC /b BDC (in) Tj EMC EMC Q", b"q  Q"),
    (b"/OC /b BDC (shown) Tj EMC", b"/OC BMC  (shown) Tj EMC"),
    (b"/OC /a BDC (never ends) Tj", b""),
    (b"(EMC \\) /OC /a BDC) Tj /S BMC EMC % /OC /a BDC\n EMC", b"(EMC \\) /OC /a BDC) Tj /S BMC EMC % /OC /a BDC\n EMC"),
    (b"BI /W 2 /F [/A /B] ID \x01/OC /a BDC EIx EI /h Do /s Do", b"BI /W 2 /F [/A /B] ID \x01/OC /a BDC EIx EI  /s Do"),
    (b"[(a) <0F> [1 <</K(])>>]] TJ /Span /p BDC EMC", b"[(a) <0F> [1 <</K(])>>]] TJ /Span BMC  EMC"),
    (b"plain (text) Tj", b"plain (text) Tj"),
]


@pytest.mark.parametrize(("data", "want"), STREAMS)
def test_hidden_content_goes(data, want):
    assert content.without_hidden(data, {b"a"}, {b"h"}) == want


def test_streams_in_a_table(spark):
    rows = [(k, d, ["a"], ["h"]) for k, (d, _) in enumerate(STREAMS)] + [(99, None, ["a"], ["h"])]
    df = spark.createDataFrame(rows, "k int, content binary, hidden_properties array<string>, hidden_objects array<string>")
    got = {r.k: r.content for r in assembly.without_hidden(df, ("k",)).collect()}
    assert got == {**{k: bytearray(w) for k, (_, w) in enumerate(STREAMS)}, 99: None}


@given(st.binary(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_bytes_are_read_to_their_end(data):
    assert content.edited(data, content.edits(data, {b"a"}, {b"h"})) is not None
    assert all(0 <= op.start <= op.end <= len(data) for op in content.operations(data))


def test_references():
    body = b"<</A 4 0 R/B(4 0 R \\) 4 0 R)/C<34>/D[5 0 R 14 0 R]/E 4 0 Rx % 4 0 R\n/F 77 0 R>>"
    assert pdf.references(body) == [4, 5, 14, 77]
    assert pdf.rewritten(body, {4: 10, 5: 2, 14: 3}) == b"<</A 10 0 R/B(4 0 R \\) 4 0 R)/C<34>/D[2 0 R 3 0 R]/E 4 0 Rx % 4 0 R\n/F null>>"


def a_file(pages, title):
    """Pages in two nodes of a tree; content streams that hold words like the format's own."""
    out = [b"%PDF-1.4\n", b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n", b"2 0 obj\n<</Type/Pages/Kids[30 0 R 3 0 R]/Count 9>>\nendobj\n", b"3 0 obj\n<</Type/Pages/Kids[%b]>>\nendobj\n" % b" ".join(b"%d 0 R" % (100 + 2 * k) for k in pages[1:]), b"30 0 obj\n<</Type/Pages/Kids[%d 0 R]>>\nendobj\n" % (100 + 2 * pages[0])]
    for k in pages:
        data = b"(page %d) Tj endobj 5 0 obj" % k
        out.append(b"%d 0 obj\n<</Type/Page/Parent 3 0 R/Contents %d 0 R>>\nendobj\n%d 0 obj\n<</Length %d>>\nstream\r\n%b\nendstream\nendobj\n" % (100 + 2 * k, 101 + 2 * k, 101 + 2 * k, len(data), data))
    return b"".join(out) + b"9 0 obj <</Title(%b)>> endobj\nxref\n0 1\ntrailer <</Root 1 0 R /Info 9 0 R>>\nstartxref\n1\n%%%%EOF" % title


def test_parts_are_joined(spark):
    rows = [(f, part, a_file([3 * part, 3 * part + 1, 3 * part + 2], b"secret")) for f in "ab" for part in range(3 if f == "a" else 1)]
    df = spark.createDataFrame(rows, "file string, part int, content binary").repartition(3)
    files = {r.file: bytes(r.content) for r in assembly.whole(assembly.assembled(df)).collect()}
    for f, n in (("a", 9), ("b", 3)):
        found = pdf.objects(files[f])
        assert b"secret" not in files[f] and [o.number for o in found] == list(range(1, 3 + 2 * n))
        pages = sorted((o for o in found if o.kind == "page"), key=lambda o: o.page)
        streams = {o.number: o.stream for o in found}
        assert [streams[pdf.reference(o.body, b"Contents")] for o in pages] == [b"(page %d) Tj endobj 5 0 obj" % k for k in range(n)] and all(pdf.reference(o.body, b"Parent") == 2 for o in pages)
        at = int(files[f].rsplit(b"startxref\n", 1)[1].split()[0])
        table = files[f][at:].split(b"\n")[3:]
        assert all(files[f][int(line[:10]) :].startswith(b"%d 0 obj" % (k + 1)) for k, line in enumerate(table[: 2 + 2 * n]))
    with pytest.raises(ValueError, match="table"):
        pdf.objects(b"%PDF-1.5 1 0 obj <<>> endobj startxref")


@pytest.mark.parametrize(("bits", "components"), [(1, 1), (8, 1), (8, 3)])
def test_pixels(bits, components):
    rng = np.random.default_rng(bits + components)
    image = (rng.integers(0, 2, (7, 11, components)) * 255).astype(np.uint8)
    data = images.packed(image, bits)
    assert (images.pixels(data, 11, 7, components, bits) == image).all()
    filled = images.fill(images.pixels(data, 11, 7, components, bits), [(2, 1, 5, 4)], 0)
    assert not filled[1:4, 2:5].any() and (np.delete(filled, range(1, 4), 0) == np.delete(image, range(1, 4), 0)).all()


def test_regions_of_turned_and_flat_images(spark):
    rows = [([0.0, 10.0, -10.0, 0.0, 10.0, 0.0], 10, 20), ([0.0, 0.0, 0.0, 0.0, 1.0, 1.0], 5, 5)]
    df = spark.createDataFrame(rows, "m array<double>, w int, h int")
    rects = F.array(F.array(*map(F.lit, (2.0, 4.0, 3.0, 5.0))))
    got = [[tuple(p) for p in r[0]] for r in df.select(images.pixel_regions(F.col("m"), F.col("w"), F.col("h"), rects)).collect()]
    # x' = 10 - 10 y, y' = 10 x: the box is x 0.4 to 0.5, y 0.7 to 0.8 of the unit square.
    assert got == [[(3, 13, 6, 17)], []]

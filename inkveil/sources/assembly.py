"""PDF files joined from parts: objects are renumbered, references follow, and the parts' catalogues and metadata go."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from inkveil.functions import content, pdf

#: The first number of objects from parts; the catalogue and the root of the pages are 1 and 2.
FIRST, ROOT = 3, 2
HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
_GONE = ("catalog", "info", "pages")


def objects(parts: DataFrame) -> DataFrame:
    """file, part, number, kind, page, body, stream and refs of all objects of parts (file, part, content)."""

    def run(batches):
        for batch in batches:
            for file, part, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                found = pdf.objects(data.as_py())
                own = pa.array([file.as_py()] * len(found), batch.schema.field(0).type), pa.array([part.as_py()] * len(found), pa.int64())
                values = [[o.number for o in found], [o.kind for o in found], [o.page for o in found], [o.body for o in found], [o.stream for o in found], [pdf.references(o.body) for o in found]]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names)

    names = ["file", "part", "number", "kind", "page", "body", "stream", "refs"]
    kind = dict(parts.dtypes)["file"]
    return parts.select("file", F.col("part").cast("long").alias("part"), "content").mapInArrow(run, f"file {kind}, part long, number long, kind string, page long, body binary, stream binary, refs array<long>")


def _before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows of (file, part, ...) with the sum of a value over all rows before: within the part, and over the parts before it."""
    sums = rows.groupBy("file", "part").agg(F.sum(value).alias("_sum"))
    over = W.Window.partitionBy("file").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = W.Window.partitionBy("file", "part").orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    earlier = sums.select("file", "part", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_earlier"))
    return rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(earlier, ["file", "part"]).withColumn("_before", F.col("_earlier") + F.col("_inside")).drop("_earlier", "_inside")


def numbered(found: DataFrame) -> DataFrame:
    """file, part, number and its new number: kept objects in the order of parts and numbers, nodes of the pages as the new root."""
    kept = _before(found.where(~F.col("kind").isin(*_GONE)).select("file", "part", "number", F.lit(1).alias("_one")), "number", "_one")
    nodes = found.where("kind = 'pages'").select("file", "part", "number", F.lit(ROOT).cast("long").alias("new"))
    return kept.select("file", "part", "number", (F.col("_before") + FIRST).alias("new")).union(nodes)


def assembled(parts: DataFrame) -> DataFrame:
    """file, number, offset, bytes: the files' pieces, in the order of their numbers; 0 is the header, 1 and 2 stand behind all objects with the table."""
    found = objects(parts)
    new = numbered(found)
    key = ["file", "part", "number"]
    links = found.select(*key, F.explode("refs").alias("ref")).join(new.select("file", "part", F.col("number").alias("ref"), F.col("new").alias("to")), ["file", "part", "ref"])
    maps = links.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("ref", "to"))).alias("numbers"))
    kept = found.where(~F.col("kind").isin(*_GONE)).join(new, key).join(maps, key, "left").select("file", "part", "page", "new", "body", "stream", "numbers")

    def write(batches):
        for batch in batches:
            own = [batch.column(c) for c in ("file", "part", "page", "new")]
            maps = [dict(m or ()) for m in batch.column("numbers").to_pylist()]
            made = [pdf.written(n, pdf.rewritten(b, m), s) for n, b, s, m in zip(*(batch.column(c).to_pylist() for c in ("new", "body", "stream")), maps, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(made, pa.binary()), pa.array(map(len, made), pa.int64())], ["file", "part", "page", "number", "bytes", "size"])

    kind = dict(parts.dtypes)["file"]
    pieces = kept.mapInArrow(write, f"file {kind}, part long, page long, number long, bytes binary, size long")
    placed = _before(pieces, "number", "size").withColumn("offset", F.col("_before") + len(HEADER))
    # The table has a line for each object of a file, so a file's table is one row.
    pages = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("part", "page", "number"))))
    ends = placed.groupBy("file").agg(pages.alias("pages"), F.array_sort(F.collect_list(F.struct("number", "offset"))).alias("objects"), F.max(F.col("offset") + F.col("size")).alias("end"))
    text = lambda c: F.encode(c, "ISO-8859-1")
    line = lambda at: F.concat(F.lpad(at.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    catalog = F.lit("1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n")
    root = F.concat(F.lit("2 0 obj\n<</Type/Pages/Count "), F.size("pages"), F.lit("/Kids["), F.array_join(F.transform("pages", lambda p: F.concat(p["number"].cast("string"), F.lit(" 0 R"))), " "), F.lit("]>>\nendobj\n"))
    total = (F.size("objects") + FIRST).cast("string")
    both = F.concat(catalog, root)
    table = F.concat(F.lit("xref\n0 "), total, F.lit("\n0000000000 65535 f \n"), line(F.col("end")), line(F.col("end") + F.length(catalog)), F.array_join(F.transform("objects", lambda o: line(o["offset"])), ""))
    tail = F.concat(both, table, F.lit("trailer\n<</Size "), total, F.lit("/Root 1 0 R>>\nstartxref\n"), (F.col("end") + F.length(both)).cast("string"), F.lit("\n%%EOF\n"))
    heads = ends.select("file", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("offset"), F.lit(HEADER).alias("bytes"))
    return placed.select("file", "number", "offset", "bytes").union(heads).union(ends.select("file", (F.size("objects") + FIRST).cast("long"), "end", text(tail)))


def whole(pieces: DataFrame) -> DataFrame:
    """file and content: a file's pieces in one row, for files that fit one."""
    joined = F.array_sort(F.collect_list(F.struct("number", "bytes")))

    @F.udf("binary")
    def join(parts):
        return b"".join(bytes(p["bytes"]) for p in parts)

    return pieces.groupBy("file").agg(joined.alias("parts")).select("file", join("parts").alias("content"))


def without_hidden(streams: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep and content of streams (content, hidden_properties, hidden_objects: names) without hidden content and properties of marks.

    Streams that hold no mark and no hidden object don't go through Python."""
    latin = F.decode("content", "ISO-8859-1")
    touched = latin.contains("BDC") | ((F.size("hidden_objects") > 0) & latin.rlike(r"Do(?:\s|\x00|\z)"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in streams.select(*keep).dtypes)

    def run(batches):
        for batch in batches:
            names = [[{x.encode("latin-1") for x in own or ()} for own in batch.column(c).to_pylist()] for c in ("hidden_properties", "hidden_objects")]
            made = [content.without_hidden(d, p, o) for d, p, o in zip(batch.column("content").to_pylist(), *names, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(made, pa.binary())], [*keep, "content"])

    filtered = streams.where(touched).select(*keep, "content", "hidden_properties", "hidden_objects").mapInArrow(run, f"{kinds}, content binary")
    return filtered.union(streams.where(~F.coalesce(touched, F.lit(False))).select(*keep, "content"))

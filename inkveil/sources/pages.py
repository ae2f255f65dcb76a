"""Pages to look through: documents of a table, synthetic records, files; and sinks for results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Files of more bytes aren't read.
MAX_FILE_BYTES = 2_147_483_647
#: Bytes at the end of a file that its trailer is looked for in.
TRAILER_BYTES = 4096


def documents(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """file, doc_id, text and, if numbered, page_no: a source is a file, its documents in order are its pages.

    Pages are numbered without their texts; the numbers come back by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("file"))
    return docs.join(page_numbers(docs, "file", "doc_id"), ["file", "doc_id"]) if numbered else docs


def page_numbers(pages: DataFrame, file: str, order: str, piece: int = 1 << 16) -> DataFrame:
    """file, order and page_no: numbers within pieces of the order, and how many pages come before a piece, so no file is sorted in one task.

    order: a whole number, distinct within a file."""
    own = pages.select(file, order, F.floor(F.col(order) / piece).alias("_piece"))
    sizes = own.groupBy(file, "_piece").agg(F.count("*").alias("_n"))
    before = sizes.select(file, "_piece", F.coalesce(F.sum("_n").over(W.Window.partitionBy(file).orderBy("_piece").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = own.withColumn("_k", F.row_number().over(W.Window.partitionBy(file, "_piece").orderBy(order)))
    return inside.join(before, [file, "_piece"]).select(file, order, (F.col("_before") + F.col("_k")).cast("int").alias("page_no"))


# What synthetic records are made of.
FIRST = ("Ottoline", "Casimir", "Perpetua", "Leopold", "Isolde", "Barnabas", "Rosalind")
LAST = ("Brackwater", "Vanstone", "Holloway", "Featherby", "Quillfeather")
STREET = ("Willowmere", "Castlegate", "Thornbury", "Larkspur")
CITY = ("Modesto", "Stockton", "Visalia")


def pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.lit(list(values)), (k % len(values) + 1).cast("int"))


def padded(k: Column, n: int) -> Column:
    return F.lpad(k.cast("string"), n, "0")


def record_fields(k: Column, c: Column, date: Column) -> dict[str, Column]:
    """Parts of the record of an order k of customer c; those of the person depend on c alone."""
    return {
        "name": F.concat_ws(" ", pick(FIRST, c), pick(LAST, c)),
        "reversed_name": F.concat(F.upper(pick(LAST, c)), F.lit(", "), F.upper(pick(FIRST, c))),
        "dob": F.concat_ws("/", padded(c % 12 + 1, 2), padded(c % 28 + 1, 2), (c % 50 + 1940).cast("string")),
        "ssn": F.concat_ws("-", padded(k % 899 + 100, 3), padded(c % 80 + 13, 2), padded(k % 9999 + 1, 4)),
        "mrn": padded(k, 8),
        "dl": F.concat(F.char((c % 26 + 65).cast("int")), padded(k, 7)),
        "cii": F.concat(F.lit("A"), padded(c, 8)),
        "address": F.concat((c % 9000 + 100).cast("string"), F.lit(" "), pick(STREET, c), F.lit(" Road, "), pick(CITY, c), F.lit(", CA "), (c % 9000 + 90000).cast("string")),
        "phone": F.concat(F.lit("("), (c % 700 + 200).cast("string"), F.lit(") 555-"), padded(c % 10000, 4)),
        "visit": F.concat(F.date_format(date, "MM/dd/yyyy"), F.lit(" 1256")),
        "first": pick(FIRST, c),
        "last": pick(LAST, c),
        "long_dob": F.concat(pick(MONTH_NAMES, c), F.lit(" "), (c % 28 + 1).cast("string"), F.lit(", "), (c % 50 + 1940).cast("string")),
        "masked_ssn": F.concat(F.lit("XXX-XX-"), padded(k % 9999 + 1, 4)),
        "plain_ssn": F.concat(padded(k % 899 + 100, 3), padded(c % 80 + 13, 2), padded(k % 9999 + 1, 4)),
        "po_box": F.concat(F.lit("P.O. Box "), (c % 9000 + 100).cast("string"), F.lit(", "), pick(CITY, c), F.lit(", CA "), (c % 9000 + 90000).cast("string")),
        "long_phone": F.concat(F.lit("+1 "), (c % 700 + 200).cast("string"), F.lit(" 555 "), padded(c % 10000, 4), F.lit(" ext. 12")),
        "wrapped_phone": F.concat(F.lit("("), (c % 700 + 200).cast("string"), F.lit(")\n555-"), padded(c % 10000, 4)),
        "city_line": F.concat(pick(CITY, c), F.lit(", CA "), (c % 9000 + 90000).cast("string")),
        "wrapped_name": F.concat_ws("\n", pick(FIRST, c), pick(LAST, c)),
        "damaged_name": F.translate(F.upper(F.concat_ws(" ", pick(FIRST, c), pick(LAST, c))), "O", "0"),
        "damaged_ssn": F.concat_ws("-", padded(k % 899 + 100, 3), padded(c % 80 + 13, 2), F.translate(padded(k % 9999 + 1, 4), "01", "Ol")),
        "damaged_dob": F.concat_ws("/", F.translate(padded(c % 12 + 1, 2), "0", "O"), padded(c % 28 + 1, 2), (c % 50 + 1940).cast("string")),
        "damaged_phone": F.concat(F.lit("("), (c % 700 + 200).cast("string"), F.lit(") 555-"), F.substring(padded(c % 10000, 4), 1, 2), F.translate(F.substring(padded(c % 10000, 4), 3, 2), "0", "O")),
    }


MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

#: Templates of records: literal text and, as (part, category), what is to be found in it (category: None for what isn't).
HARMLESS = "Charge $1,234.56 CPT 99213"
TEMPLATES: dict[str, list] = {
    "form": [
        "Patient: ", ("reversed_name", "name"), "\nDOB: ", ("dob", "dob"), "\nSSN: ", ("ssn", "ssn"), "\nMRN: ", ("mrn", "account"), "\nDriver's License #: ", ("dl", "dl"), "\nCII: ", ("cii", "ncic"),
        "\nHome: ", ("address", "address"), "\nCell ", ("phone", "phone"), "\nVisit ", ("visit", None), "\n",
    ],
    "letter": [
        "Dear ", ("name", "name"), ",\nour file says that you were born ", ("long_dob", "dob"), ".\nYour number ", ("masked_ssn", "ssn"), " is on it. We wrote to ", ("po_box", "address"), ".\nCall ", ("long_phone", "phone"), " today.\n",
    ],
    "table": [
        "MRN          Seen on\n", ("mrn", "account"), "     ", ("visit", None), "\nLicense number: ", ("dl", "dl"), "\nState ID No. ", ("cii", "ncic"), "\nSSN ", ("plain_ssn", "ssn"), "\nName ", ("reversed_name", "name"), "\n",
    ],
    "damaged": [
        "Client ", ("damaged_name", "name"), " has SSN ", ("damaged_ssn", "ssn"), "\nand was born on ", ("damaged_dob", "dob"), "\nPhone: ", ("damaged_phone", "phone"), "\n",
    ],
    "wrapped": [
        "Today ", ("wrapped_name", "name"), " came in.\nMedical\nRecord ", ("visit", None), "\n", ("mrn", "account"), "\nTelephone ", ("wrapped_phone", "phone"), "\nlives in ", ("city_line", "address"), "\n",
    ],
}


def record_kind(k: Column) -> Column:
    """The template of a record; some records are fax covers, some empty."""
    return F.when(k % 211 == 0, "empty").when(k % 97 == 0, "fax").otherwise(F.element_at(F.lit(list(TEMPLATES)), (F.floor(k / 4) % len(TEMPLATES) + 1).cast("int")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, subject_id, kind, text: one page for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, kind = F.col("o_orderkey"), record_kind(F.col("o_orderkey"))
    fields = record_fields(k, F.col("o_custkey"), F.col("o_orderdate"))
    text = F.when(kind == "empty", "").when(kind == "fax", "Fax cover")
    for name, parts in TEMPLATES.items():
        text = text.when(kind == name, F.concat(*[F.lit(p) if isinstance(p, str) else fields[p[0]] for p in parts], F.lit(HARMLESS)))
    return orders.select(k.alias("record_id"), F.col("o_custkey").alias("subject_id"), kind.alias("kind"), text.alias("text"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each customer."""
    c = F.col("c_custkey")
    fields = record_fields(c, c, F.lit("2020-01-01").cast("timestamp"))
    none = F.array().cast("array<string>")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c.alias("subject_id"), fields["name"].alias("full_name"), none.alias("variants"), F.concat(*[F.substring(p, 1, 1) for p in (pick(FIRST, c), pick(LAST, c))]).alias("initials"), fields["dob"].alias("dob"),
        F.array(fields["address"], fields["po_box"]).alias("addresses"), F.array(fields["phone"]).alias("phones"), none.alias("other_names"), none.alias("other_addresses"), none.alias("other_phones"),
    )


def files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(name, size_bytes, content) of the files that can be read, and (name, reason) of those that can't: too large, no PDF, or encrypted.

    Contents of files that are too large are never read: Spark's reader passes them over by their length."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    large = found.where(F.col("length") > most_bytes).select(name, F.lit("too large").alias("reason"))
    read = found.where(F.col("length") <= most_bytes).select(name, F.col("length").alias("size_bytes"), "content")
    # A password needs an /Encrypt entry in the trailer, behind the last table of objects, or in a dictionary of an object stream.
    tail = F.decode(F.right("content", F.lit(TRAILER_BYTES)), "ISO-8859-1")
    locked = tail.rlike(r"(?s)(?:trailer|/XRef\b).*/Encrypt\s+[0-9]+\s+[0-9]+\s+R")
    reason = F.when(F.decode(F.substring("content", 1, 5), "ISO-8859-1") != "%PDF-", "not a PDF").when(F.length("content") == 0, "not a PDF").when(locked, "needs a password")
    marked = read.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("name", "reason").union(large)


def output_names(name: Column) -> dict[str, Column]:
    base = F.regexp_replace(name, r"(?i)\.pdf$", "")
    return {"redacted": F.concat(base, F.lit("_REDACTED.pdf")), "exceptions": F.concat(base, F.lit("_EXCEPTIONS.pdf"))}


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results replace older ones; a run that fails leaves no part of them."""
    df.write.mode("overwrite").format(kind).save(path)

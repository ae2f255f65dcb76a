"""Column layouts and the categories of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories, their labels, in report order.
CATEGORIES = {
    "name": "Protected names",
    "ssn": "Social Security numbers",
    "dl": "Driver's license numbers",
    "ncic": "NCIC/CII numbers",
    "account": "Account and record numbers",
    "dob": "Dates of birth",
    "address": "Addresses",
    "phone": "Phone numbers",
    "other": "Other protected persons",
}

#: A subject: whose data is looked for.
SUBJECT = (
    "subject_id long, full_name string, variants array<string>, initials string, dob string, addresses array<string>, phones array<string>, "
    "other_names array<string>, other_addresses array<string>, other_phones array<string>"
)
#: Half-open spans in code points; ord is the detectors' order, which breaks ties.
HIT = "cat string, start int, end int, ord int, initials string"
DATE = "start int, end int, partial boolean, cands array<struct<y: int, y2: boolean, m: int, d: int>>"


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, label) for k, (c, label) in enumerate(CATEGORIES.items())], "sort_no int, cat string, label string")

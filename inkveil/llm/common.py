"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z alone; every other byte stays as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: What separates words.
SPACES = b" \t\n\x0b\x0c\r"


#: What this process's operators remember between tasks.
REMEMBERED: list[dict] = []


def forget() -> None:
    """Gives back what operators of earlier stages remember: workers outlive a stage."""
    for own in REMEMBERED:
        own.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/.inkveil"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/inkveil-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor takes none of it along."""
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Bytes of text in a slice of a batch.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many bytes of a text column, or of one row: what a worker holds doesn't hang on the rows of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Keys of more rows than this, and than that part of all rows, are spread over the tasks of a join.
LARGE_ROWS, MAX_LARGE = 1000, 10_000


def joined_spread(rows: DataFrame, table: DataFrame, on: tuple[str, ...], salt: Column) -> DataFrame:
    """rows left joined with a table that has one row for each key `on`, and in its column `rows` how many rows hold the key.

    Keys of very many rows, MAX_LARGE at most by their share of all rows, are broadcast, and their rows are spread by the salt."""
    total = table.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    large = F.col("rows") > max(LARGE_ROWS, total // MAX_LARGE)
    values = [c for c in table.columns if c not in (*on, "rows")]
    named = lambda df, side: df.select(*[F.col(c).alias(f"_{side}_{c}") for c in (*on, *values)], F.lit(0).cast("long").alias(f"_{side}_salt"))
    same = lambda side: reduce(and_, [F.col(k) == F.col(f"_{side}_{k}") for k in on])
    first = rows.join(F.broadcast(named(table.where(large), "large")), same("large"), "left")
    spread = first.withColumn("_salt", F.when(F.col("_large_salt").isNull(), F.lit(0).cast("long")).otherwise(salt))
    found = spread.join(named(table.where(~large), "small"), same("small") & (F.col("_salt") == F.col("_small_salt")), "left")
    return found.select(*rows.columns, *[F.coalesce(f"_large_{c}", f"_small_{c}").alias(c) for c in values])


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared file system."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_written(df: DataFrame) -> None:
    """Deletes the table behind a frame that written() gave."""
    remove(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds that queries learn from and hold out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))

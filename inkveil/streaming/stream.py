"""Redaction of pages as they come: a stream of Parquet pages, written and counted batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from inkveil.operators import detect, report, spans


def read_pages(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def redact_stream(pages: DataFrame, subjects: DataFrame, keys: tuple[str, ...], out: str, on: str | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts writing redacted pages and, for each batch, counts of its hits under `out`; a batch written again replaces itself.

    after: called with what was found on a batch's pages (keys, redacted, merged) and its number. stop() of the result cancels the run;
    started again with the same `out` it goes on where it stopped."""

    def batch(df: DataFrame, number: int) -> None:
        found = detect.detect(df, subjects, keys, on).withColumn("merged", spans.merged(F.col("hits")))
        done = found.select(*keys, spans.redacted(F.coalesce("text", F.lit("")), F.col("merged")).alias("redacted"), "merged").persist(StorageLevel.DISK_ONLY)
        try:
            done.select(*keys, "redacted").write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
            counted = report.counts(done.select(F.inline("merged"))).withColumn("batch", F.lit(number))
            counted.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
            if after:
                after(done, number)
        finally:
            done.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Tells a callback of each batch: its number, its rows, and all rows so far; seldom more often than every `rows` rows."""

    def __init__(self, tell: Callable[[int, int, int], None], rows: int = 0):
        self.tell, self.rows, self.total, self.told = tell, rows, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.total = self.told = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.total += event.progress.numInputRows
        if self.total - self.told >= self.rows:
            self.told = self.total
            self.tell(event.progress.batchId, event.progress.numInputRows, self.total)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def stream_folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors see: under spark.checkpoint.dir, or in the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def redacted_at_once(pages: str, pattern: str, schema, to_pages: Callable[[DataFrame], DataFrame], subjects: DataFrame, keys: tuple[str, ...], on: str | None = None) -> DataFrame:
    """The counts of all batches of a stream of Parquet files of a folder, redacted as they come."""
    spark = subjects.sparkSession
    out = stream_folder(spark)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(f"{pages}/{pattern}")
    redact_stream(to_pages(rows), subjects, keys, out, on).awaitTermination()
    return spark.read.parquet(f"{out}/counts")

"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage works on all rows that the stage before kept. The first four return the columns of documents; the last
returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import mixing, near_dup, packing, quality_rules, toxicity
from inkveil.llm.common import bucket_of, table, text_of, written
from inkveil.llm.tokens import vocabulary_file

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    labels = table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, labels, keep=tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(docs, trusted, keep=tuple(docs.columns)).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by shingles of five words and a similarity of 0.8.

    Rows of equal doc_ids are one document: of those of a kept id the one with the smallest hash of its text stays (among equal hashes, of all its columns). Rows without a doc_id all stay."""
    kept = near_dup.dedup(docs, n=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")
    order = F.struct(F.xxhash64(text_of(F.col("text"))), F.xxhash64(*docs.columns))
    no_id = F.col("doc_id").cast("long").isNull()
    once = rows.where(~no_id).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min_by(F.struct(*docs.columns), order).alias("own")).select("own.*")
    return once.unionByName(rows.where(no_id))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: rows repeat as often as the mix takes them, the last of a source may be cut."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs, vocabulary_file(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models and the tokenizer have no SQL. Tests hold the operators, and the near-duplicate stage, against brute force; no test covers run() or the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query for each operator, over its whole table; and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bloom_lookup, mixing, near_dup, packing, quality_rules, suffix_tree, token_planes, toxicity, url_filter, warc
from inkveil.llm.common import bucket_of, table
from inkveil.llm.tokens import vocabulary_file

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
VOCABULARY = "word_bpe_49k.json"


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words that the mix takes, and the shards that they're dealt to."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("shards", F.col("pieces.shard")).drop("pieces")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.fingerprints(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.dedup(table(spark, sf_dir, "documents"), n=2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted)


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.digests(table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out), more={"held_out": held_out})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_bloom_lookup": op5_bloom_lookup,
    "op6_near_dup": op6_near_dup,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_planes": op9_token_planes,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
        b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest FROM d),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to FROM k
    """,
}

"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import brown, chat, compression, decontaminate, idstore, licenses, mixing, simhash, tokencount, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_results(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return compression.quality(docs, compression.fitted(docs, compression.labels_in(spark, sf_dir)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(_table(spark, sf_dir, "documents")).taken()


def op4_repair_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.store_and_read(_table(spark, sf_dir, "documents"))


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("score").cast("double").alias("score"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_compression_bands,
        op3_mix_sources,
        op4_repair_roles,
        op5_warc_archives,
        op6_brown_classes,
        op7_id_files,
        op8_count_tokens,
        op9_benchmark_leaks,
        op10_license_scan,
    )
}

#: WARC digests are the one result here that SQL gives in full; the rest are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_warc_archives": """
      WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
           d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
           k AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
             CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k""",
}

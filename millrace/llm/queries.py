"""Thin queries over the synthetic tables, one an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, embedding_dedup, jaccard_join, packing, pii, quality, substring_dedup, token_files, toxicity, warc
from millrace.llm.common import table


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, payload_digest,
  CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best = page_id THEN NULL ELSE best END AS refers_to FROM q
"""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.group_vectors(table(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op7_embedding_dedup, op3_jaccard_join, op2_bpe, op4_token_files, op5_pii, op6_quality, op8_packing, op9_toxicity, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": OP10_SQL}

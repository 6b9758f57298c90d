"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import alignment, html, line_dedup, lm, merkle, minhash, mixing, packing, quality, shards, token_files, url_filter, vectors
from siltstone.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.token_index(token_files.read_tokens(spark, path))


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sharded = shards.ShardedTable(spark, fresh(spark, "sharded"))
    sharded.append(docs)
    sharded.compact()
    rows = sharded.read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_html_blocks": op3_html_blocks,
    "op4_vector_near_dedup": op4_vector_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_repetition_coverage": op6_repetition_coverage,
    "op7_sharding": op7_sharding,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_line_alignment": op9_line_alignment,
    "op10_log_bilinear": op10_log_bilinear,
    "op11_redirect_equivalence": op11_redirect_equivalence,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.ORACLE,
    "op6_repetition_coverage": quality.ORACLE,
    "op7_sharding": shards.ORACLE,
    "op11_redirect_equivalence": url_filter.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}

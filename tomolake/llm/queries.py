"""The queries of this subpackage, for the registry at the top of the repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomolake.llm import alignment, chat, collocations, decontaminate, embeddings, language, licenses, quality, rollup, segment, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.digests(segment.sample_segmentations(_table(spark, sf_dir, "documents")))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.maintained_totals(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.corpus_alignment(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gumbel_segmentations, op2_warc_archive, op3_toxicity, op4_embedding_neardup, op5_chat_perspectives, op6_language_id, op7_simhash_neardup, op8_token_rollup, op9_quality, op10_decontamination, op11_collocations, op12_license_scan, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_archive": warc.ORACLE_SQL, "op5_chat_perspectives": chat.ORACLE_SQL, "op10_decontamination": decontaminate.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_license_scan": licenses.ORACLE_SQL}

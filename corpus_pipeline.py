"""A corpus pipeline: documents go through five operators, each stage written as Parquet and read by the next.

Every stage judges rows one by one or by their own number, so repeated rows, null and repeated ids pass like others; null
and empty texts are texts without words; an empty table stays empty. All stages but the last return the columns they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomolake.llm import decontaminate, language, segment, simhash, toxicity
from tomolake.llm.common import drop_path, dropped_after, new_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts stay."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def reject_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones too, and those in none of the learned languages go."""
    return language.reject_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id, of equal ones the first row."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; those without words stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document that is left (one where it has only one)."""
    return segment.digests(segment.sample_segmentations(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("segmentation", sample_segmentations),
]

#: None: classifiers, hashes and sampling are outside SQL. Tests hold the stages against their operators, those against
#: plain versions, and run() against plain code over raw rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and its input, go once its output is committed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with dropped_after(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs

"""The corpus pipeline: documents through quality rules, classifier, near-dedup and decontamination into packed sequences.

Each stage works on everything its predecessor kept and returns the columns of
documents; the last returns the placed pieces. Decisions are made per doc_id: a
doc_id of which any row is rejected goes. Rows without a doc_id can't be named by a decision and
stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import delete, without, written
from turnwise.llm.decontaminate import decontaminate
from turnwise.llm.near_dedup import near_dedup
from turnwise.llm.packing import best_fit_packing
from turnwise.llm.quality_classifier import quality_classifier
from turnwise.llm.quality_rules import quality_rules


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return without(docs, quality_rules(docs).where(~F.col("kept")))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, predicts to be good."""
    judged = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, judged.where("predicted = 0"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return without(docs, near_dedup(docs).where(~F.col("kept")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, judged.where("contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written once and its predecessor's removed."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

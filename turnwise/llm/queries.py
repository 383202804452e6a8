"""The registered queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import sql
from turnwise.llm.common import scratch_dir
from turnwise.llm.decontaminate import decontaminate
from turnwise.llm.license_scan import as_files, license_scan
from turnwise.llm.near_dedup import near_dedup
from turnwise.llm.packing import best_fit_packing
from turnwise.llm.quality_classifier import quality_classifier
from turnwise.llm.quality_rules import quality_rules
from turnwise.llm.token_files import token_files
from turnwise.llm.toxicity import toxicity
from turnwise.llm.url_filter import url_filter
from turnwise.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark, sf_dir):
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark, sf_dir):
    return token_files(_table(spark, sf_dir, "documents"), scratch_dir(spark, "tokens"))


def op6_warc(spark, sf_dir):
    return warc_round_trip(_table(spark, sf_dir, "pages"), scratch_dir(spark, "warc")).drop("url")


def op7_best_fit_packing(spark, sf_dir):
    return best_fit_packing(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return license_scan(as_files(_table(spark, sf_dir, "documents")), carry=("doc_id",))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op10_url_filter(spark, sf_dir):
    return url_filter(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filter": op10_url_filter,
}
ORACLE_SQL = {
    "op1_quality_rules": sql.OP1,
    "op2_minhash_near_dedup": sql.OP2,
    "op6_warc": sql.OP6,
    "op8_license_scan": sql.OP8,
    "op9_benchmark_decontamination": sql.OP9,
    "op10_url_filter": sql.OP10,
}

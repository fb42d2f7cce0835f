"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelens.llm import language_id, license_scan, media, mixing, packing, quality_rules, resampling, simhash, suffix_dedup, toxicity
from corelens.session import few_files, table

#: Documents of a result file, at least.
DOCS_PER_FILE = 5_000


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(suffix_dedup.dedup_with_passages(docs), docs.count(), DOCS_PER_FILE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(simhash.near_duplicates(docs), docs.count(), DOCS_PER_FILE)


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(packing.packed(docs), docs.count(), DOCS_PER_FILE)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(mixing.mixed(docs).withColumn("n_copies", F.size("copies")).drop("h", "copies"), docs.count(), DOCS_PER_FILE)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_toxicity, op3_importance_resampling, op4_transport_streams, op5_license_scan, op6_simhash_balls, op7_retrieval_packing, op8_quality_rules, op9_source_mix, op10_language_id)}
ORACLES = {"op5_license_scan": license_scan.oracle(), "op8_quality_rules": quality_rules.ORACLE}

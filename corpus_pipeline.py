"""A corpus pipeline of five operators: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelens.llm import mixing, near_copies, packing, suffix_dedup, toxicity
from corelens.session import few_files, table, written

#: Documents of a file that a stage writes, at least.
DOCS_PER_FILE = 5_000
#: A passage goes if it repeats and has this many words; it's sought by repeated strings of so many bytes (50 words of under four letters).
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _filed(out: DataFrame, docs: DataFrame) -> DataFrame:
    return few_files(out, docs.count(), DOCS_PER_FILE)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    return _filed(toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return _filed(near_copies.representatives(docs), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_WORDS words that repeat across them; shorter repeats, such as common lines, stay."""
    return _filed(_recounted(suffix_dedup.dedup_documents(docs, PASSAGE_BYTES, PASSAGE_WORDS)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _filed(_recounted(mixing.mix_documents(docs, ordered=False)), docs)  # packing orders them anew


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return _filed(packing.packed(docs), docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Scores of a classifier, suffix orders and BM25 orders are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k + 1 == len(STAGES) else written(out, name)
    return docs

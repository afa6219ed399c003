"""The corpus pipeline: from raw documents to a decontaminated mix of sources.

Each stage is a function of ``(spark, docs, sf_dir)`` that returns the documents it keeps,
with the columns of ``documents``; the last one adds ``copy``, the number of a row's copy.
Every stage is written as Parquet and read again as the next one's input, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecreduce.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from vecreduce.llm.common import saved

#: Texts whose best language is less likely than this are rejected, and texts without letters.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay.  The model is learned from the labelled ones."""
    model = language_id.fit(docs)
    found = language_id.predicted(docs, model, keep=tuple(docs.columns))
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return found.where(known).select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return exact_dedup.surviving_rows(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id."""
    return simhash.one_of_each_component(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_spans(docs, benchmark, length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: each document as often as the mix takes it."""
    return mixing.copied(docs)


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

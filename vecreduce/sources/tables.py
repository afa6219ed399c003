"""Parquet table loaders.

Columns are selected right at the scan so the parquet reader only decodes
what a query needs (``ReadSchema`` in the plan); filters written after the
load are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def embeddings(spark: SparkSession, sf_dir: str, columns=("vec_id", "embedding")) -> DataFrame:
    return load(spark, sf_dir, "embeddings", columns)


def events(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return load(spark, sf_dir, "events", columns)


def lineitem(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return load(spark, sf_dir, "lineitem", columns)


def labels(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return load(spark, sf_dir, "labels", columns)

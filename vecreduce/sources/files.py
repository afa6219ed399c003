"""File formats besides parquet: LibSVM and dense comma-separated matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: separator of the dense text matrix format.
DENSE_SEPARATOR = ", "


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """LibSVM text as ``(label double, features vector)``.

    Pass ``num_features``: without it Spark runs an extra pass over the data
    to find the largest index.
    """
    reader = spark.read.format("libsvm")
    if num_features:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Write ``(label, features)``; an ``array<…>`` features column is converted to a vector."""
    from pyspark.ml.functions import array_to_vector

    feat = F.col(features)
    if not str(df.schema[features].dataType).startswith("VectorUDT"):
        feat = array_to_vector(F.col(features).cast("array<double>"))
    (df.select(F.col(label).cast("double").alias("label"), feat.alias("features"))
       .write.format("libsvm").mode("errorifexists").save(path))


def libsvm_lines(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """LibSVM lines ``value`` of an array column: the label, then ``index:value`` of non-zero elements."""
    x = F.col(features).cast("array<double>")
    stored = F.filter(F.transform(x, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"))),
                      lambda e: e.v != 0)
    entries = F.transform(stored, lambda e: F.concat_ws(":", e.i.cast("string"), e.v.cast("string")))
    return df.select(F.concat_ws(" ", F.col(label).cast("double").cast("string"), entries).alias("value"))


def parse_libsvm(lines: DataFrame, value: str = "value") -> DataFrame:
    """LibSVM lines as ``(label double, indices array<int>, values array<double>)``.

    Stored entries only, counted from 0; no width is needed or guessed.  Blank lines are skipped.
    """
    parts = F.split(F.trim(F.col(value)), r"\s+")
    entries = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda e: F.split(e, ":"))
    return lines.where(F.length(F.trim(F.col(value))) > 0).select(
        parts[0].cast("double").alias("label"),
        F.transform(entries, lambda e: e[0].cast("int") - 1).alias("indices"),
        F.transform(entries, lambda e: e[1].cast("double")).alias("values"))


def write_dense_text(df: DataFrame, path: str, vec: str = "vec") -> None:
    """One line per row: the elements as decimal text joined by ``", "``.

    Double-to-string in Spark round-trips exactly, so reading back gives the
    same doubles.
    """
    dense_lines(df, vec).write.mode("errorifexists").text(path)


def dense_lines(df: DataFrame, vec: str = "vec") -> DataFrame:
    """The lines ``value`` of a dense text matrix."""
    # array casts stay inside whole-stage codegen (a transform() lambda would not)
    return df.select(F.array_join(F.col(vec).cast("array<double>").cast("array<string>"), DENSE_SEPARATOR)
                     .alias("value"))


def read_dense_text(spark: SparkSession, path: str, vec: str = "vec") -> DataFrame:
    """A dense text matrix as ``(vec array<double>)``; see :func:`parse_dense`."""
    return parse_dense(spark.read.text(path), vec)


def parse_dense(lines: DataFrame, vec: str = "vec") -> DataFrame:
    """Lines ``value`` of a dense text matrix as ``(vec array<double>)``; blank lines are skipped.

    The format carries no row key: use it for order-free work (sums).
    """
    parts = F.split(F.trim(F.col("value")), r"\s*,\s*")
    return (lines.where(F.length(F.trim(F.col("value"))) > 0)
                 .select(parts.cast("array<double>").alias(vec)))

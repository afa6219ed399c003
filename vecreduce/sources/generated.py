"""Small generated sources: literal matrices, integer ranges, seeded gradients.

These feed unit tests and examples.  Generated rows are produced on the
executors (``spark.range`` + column arithmetic), never drawn on the driver,
so the same generator scales to any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_literal(spark: SparkSession, rows: Sequence[Sequence[float]],
                   group_size: int | None = None) -> DataFrame:
    """A literal matrix as ``(worker int, vec array<double>)``, one row per worker.

    With ``group_size`` a ``grp`` column is added (workers ``0..k-1`` form
    group 0, and so on).  Meant for fixtures: the rows travel from the driver.
    """
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "worker int, vec array<double>")
    if group_size:
        df = df.withColumn("grp", F.floor(F.col("worker") / group_size).cast("int")) \
               .select("grp", "worker", "vec")
    return df


def counting_matrix(spark: SparkSession, n_rows: int, n_cols: int) -> DataFrame:
    """``vec[c] = n_cols * worker + c + 1`` built on the executors (fixture F1 shape)."""
    return (spark.range(n_rows)
            .select(F.col("id").cast("int").alias("worker"),
                    F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)),
                                lambda c: (F.col("id") * n_cols + c + 1).cast("double"))
                    .alias("vec")))


def libsvm_fixture(spark: SparkSession, path: str, rows_per_class: int = 50, sparse_rows: int = 13,
                   seed: int = 2) -> str:
    """Write a LibSVM file shaped like the reference's MLP input and return its path.

    Three separable classes with ``rows_per_class`` rows each, four features in
    [-1, 1]; ``sparse_rows`` rows of class 1 omit feature 3 (a zero).  Fixture
    scale: the lines are produced on the driver.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    centers = np.array([[-0.6, 0.5, -0.5, -0.7], [0.1, -0.3, 0.0, 0.2], [0.7, 0.2, 0.6, 0.8]])
    lines = []
    for label in range(3):
        for i in range(rows_per_class):
            x = np.clip(centers[label] + rng.normal(0, 0.08, 4), -1, 1)
            feats = [(j + 1, x[j]) for j in range(4)]
            if label == 1 and i < sparse_rows:
                feats = [f for f in feats if f[0] != 3]
            lines.append(f"{label} " + " ".join(f"{j}:{v:.6f}" for j, v in feats))
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.text(path)
    return path


def range_source(spark: SparkSession, start: int, end: int, num_partitions: int | None = None,
                 name: str = "id") -> DataFrame:
    """Integer range ``[start, end)`` split over ``num_partitions`` tasks."""
    df = spark.range(start, end, 1, num_partitions)
    return df if name == "id" else df.withColumnRenamed("id", name)


def key_domain(df: DataFrame, key: str) -> DataFrame:
    """Every key that occurs in a table, once; null is no key."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def synthetic_gradients(spark: SparkSession, iterations: int, workers: int = 8, dims: int = 10,
                        spread: int = 15, step: int = 10, seed: int = 0) -> DataFrame:
    """Seeded per-worker gradients ``(iter, worker, dim, g)``.

    Worker ``i`` draws integers in ``[step*i, step*i + spread)`` per element,
    each iteration afresh (the shape of the reference's gradient-descent
    input).  Draws are a hash of ``(seed, iter, worker, dim)``, so they are
    reproducible and independent of partitioning.
    """
    total = iterations * workers * dims
    ids = spark.range(total)
    it = (F.col("id") / (workers * dims)).cast("long")
    wk = F.pmod((F.col("id") / dims).cast("long"), F.lit(workers))
    dm = F.pmod(F.col("id"), F.lit(dims))
    draw = F.pmod(F.xxhash64(F.lit(seed), it, wk, dm), F.lit(spread))
    return ids.select(it.cast("int").alias("iter"), wk.cast("int").alias("worker"),
                      dm.cast("int").alias("dim"),
                      (wk * step + draw).cast("double").alias("g"))

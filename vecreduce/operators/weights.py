"""Weights as a relation: versions of ``(block, w)``, joined by block.

Weights never become literals of a plan or numbers of the driver, so a plan has the same
size for ten weights and for a billion.  A version is written once and read by number, so
an iteration's lineage ends at the version before it, and a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed_point import EMBEDDING_SCALE
from ..session import scratch_path
from .blocks import WIDTH, blocks_to_dims, dims_to_blocks


class WeightTable:
    """The versions of one set of weights, Parquet tables in one folder.

    ``width`` is the number of weights of a block.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH):
        self.spark, self.width = spark, width
        self.path = path or scratch_path(spark, "weights")

    def _at(self, version: int) -> str:
        return f"{self.path}/version={int(version)}"

    def write(self, version: int, blocks: DataFrame) -> DataFrame:
        """Store ``(block, w)`` as a version and return it as stored.  A version is never overwritten."""
        blocks.select("block", "w").write.parquet(self._at(version))
        return self.read(version)

    def write_dims(self, version: int, weights: DataFrame) -> DataFrame:
        """Store ``(dim, w)`` as a version."""
        cells = weights.select("dim", F.col("w").cast("double").alias("w"))
        return self.write(version, dims_to_blocks(cells, "w", width=self.width))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("block int, w array<double>").parquet(self._at(version))

    def history(self) -> DataFrame:
        """All versions: ``(version, dim, w)``."""
        every = self.spark.read.schema("version int, block int, w array<double>").parquet(self.path)
        return blocks_to_dims(every, "w", width=self.width, keep=("version",))


def updated(weights: DataFrame, totals: DataFrame, lr: float, n: int, scale: int = EMBEDDING_SCALE,
            total: str = "total") -> DataFrame:
    """``w - lr * total / n`` block by block: ``(block, w)``.

    ``totals`` are the sums of :func:`block_all_reduce`.  Both must have the same blocks
    of the same lengths; a block that one lacks, or of another length, fails.
    """
    both = weights.select("block", "w").join(totals.select("block", F.col(total).alias("_t")), "block", "full")
    same = F.coalesce(F.size("w") == F.size("_t"), F.lit(False))
    step = F.zip_with("w", "_t", lambda w, t: w - F.lit(float(lr)) * (t.cast("double") / F.lit(float(scale)))
                      / F.lit(float(n)))
    return both.select("block", F.when(same, step).otherwise(
        F.raise_error(F.lit("vecreduce: weights and totals have different elements"))).alias("w"))


def descend(table: WeightTable, totals, lr: float, n: int, iterations: int, scale: int = EMBEDDING_SCALE,
            start: int = 0) -> DataFrame:
    """Gradient descent from version ``start``: each iteration writes the next version.

    ``totals(version, weights)`` gives the block totals of the gradients at a version's
    weights; the plan of an iteration reads only that version.  Returns the last one.
    """
    weights = table.read(start)
    for version in range(start + 1, start + iterations + 1):
        weights = table.write(version, updated(weights, totals(version - 1, weights), lr, n, scale))
    return weights

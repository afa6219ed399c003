"""Sinks: the worker x element matrix view, parquet output, and the driver edge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.layout import assemble


def matrix_rows(cells: DataFrame, row: str = "worker", value: str = "g") -> DataFrame:
    """One line per worker, as the reference prints its matrix: ``(row, n, line)``.

    ``line`` holds the worker's ``n`` elements in order, joined by ``", "``; workers may have
    vectors of different lengths.  Dims must be ``0..n-1``.
    """
    vecs = assemble(cells, keys=[row], value=value, dense=True)
    return vecs.select(row, F.size("vec").alias("n"),
                       F.array_join(F.col("vec").cast("array<string>"), ", ").alias("line"))


def show_matrix(cells: DataFrame, rows: int = 1000, row: str = "worker", value: str = "g") -> None:
    """Print the first ``rows`` workers' lines."""
    matrix_rows(cells, row, value).orderBy(row).show(rows, truncate=False)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def to_local(df: DataFrame) -> Iterator[Row]:
    """The rows of a *result* on the driver, one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)

"""Partition functions, and sums and joins by the same keys, on one layout.

Data dealt out by its keys once needs no second exchange for a sum or a join by them.  A
function that is a Column expression keeps the layout, so function, sum and join take one
exchange, or none on a table bucketed by the keys.  Behind a Python function Spark no longer
knows the layout; a function of a partition's batches therefore runs before the exchange,
where the rows are read, and again one exchange is left.

A key's rows lie in one partition, as a worker's do.  Where one key may have very many
rows, lay out by the key and a salt, and merge the few sums of a key afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.fixed_point import checked, to_fixed


def laid_out(df: DataFrame, keys: Sequence[str], partitions: int) -> DataFrame:
    """``df`` dealt out by the hash of ``keys``: the one exchange of what follows."""
    return df.repartition(partitions, *keys)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """``df`` as a table whose files are dealt out by ``keys``; reading it needs no exchange by them.

    ``path`` is a new folder that all executors reach.
    """
    laid_out(df, keys, buckets).write.option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    return df.sparkSession.table(table)


def with_function(df: DataFrame, function: Callable[[Iterator], Iterator], inputs: Sequence[str], returns: str,
                  name: str) -> DataFrame:
    """``df`` with the column ``name`` that ``function`` makes of each partition's batches.

    ``function`` takes an iterator of Arrow arrays, or of tuples of them for several
    ``inputs``, and yields an array of the same length for each; what it sets up before its
    loop is set up once a partition.
    """
    from pyspark.sql.functions import arrow_udf
    import pyarrow as pa

    if len(inputs) == 1:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from function(batches)
    else:
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from function(batches)
    run.__annotations__ = {
        "batches": Iterator[pa.Array] if len(inputs) == 1 else Iterator[tuple[pa.Array, ...]],
        "return": Iterator[pa.Array]}
    return df.withColumn(name, arrow_udf(run, returns)(*[F.col(c) for c in inputs]))


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``df`` with aggregates of its keys at every row: a sum by key and its join in one pass.

    Each of ``totals`` makes a column for a window.  Rows of a key are buffered, on disk
    where they are many.
    """
    window = Window.partitionBy(*keys)
    return df.withColumns({name: total(window) for name, total in totals.items()})


def position_weighted_column(vec: str, scale: int) -> Column:
    """The sum of ``(i + 1) * element i`` of a vector in exact fixed point, as an expression."""
    terms = F.transform(F.col(vec), lambda x, i: F.try_multiply(to_fixed(checked(x), scale), (i + 1).cast("long")))
    total = F.aggregate(terms, F.lit(0).cast("long"), F.try_add)
    return F.when(total.isNotNull(), total).otherwise(
        F.raise_error(F.lit("vecreduce: null vector, or a sum beyond BIGINT")).cast("long"))


def position_weighted(scale: int) -> Callable[[Iterator], Iterator]:
    """A partition function: the sum of ``(i + 1) * element i`` of a vector, exact fixed point."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for vectors in batches:
            if vectors.null_count or vectors.flatten().null_count:
                raise ValueError("vecreduce: null vector or element")
            offsets = vectors.offsets.to_numpy()
            flat = vectors.flatten().to_numpy().astype(np.float64) * float(scale) + 0.5
            if not (np.abs(flat) < 1e12).all():  # also NaN and infinity
                raise ValueError("vecreduce: element out of fixed-point range")
            lengths = np.diff(offsets)
            if lengths.max(initial=0) > 1_000_000:
                raise ValueError("vecreduce: vector of over a million elements")
            starts = offsets[:-1] - offsets[0]
            at = np.arange(len(flat)) - np.repeat(starts, lengths) + 1
            sums = np.concatenate([[0], np.cumsum(np.floor(flat).astype(np.int64).astype(object) * at)])
            yield pa.array((sums[offsets[1:] - offsets[0]] - sums[starts]).tolist(), pa.int64())

    return run

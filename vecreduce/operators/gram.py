"""Least squares by one exact pass: ``G = Z'Z`` of the features and the target.

The gradient of the squared error at weights ``w`` is ``X'(Xw - y) = X'X w - X'y``.  Both
products are sums over rows, so one pass over the data makes them, and every iteration of
gradient descent then works on ``d + 1`` by ``d + 1`` numbers.

Each task multiplies Arrow batches with BLAS.  Fixed-point values are split into pieces of
20 bits, a product of two pieces over 4,096 rows stays below 2^53, and such a product of
doubles is exact; the pieces' products are put together as whole numbers.  So ``G`` holds
the same integers as a sum over rows, whatever the partitioning.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_point import checked, to_fixed
from ..session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

_BITS = 20
_ROWS = 1 << 12
_MOST_CELLS = 4_000_000
_LOW = (1 << 32) - 1
_LIMIT = 9.2e18


def _pieces(z: np.ndarray) -> list[np.ndarray]:
    """``z`` as a sum of pieces times powers of 2^20; all but the last are in [0, 2^20)."""
    pieces = []
    while z.size and (int(z.max()) >= 1 << _BITS or int(z.min()) < -(1 << _BITS)):
        pieces.append((z & ((1 << _BITS) - 1)).astype(np.float64))
        z = z >> _BITS
    return pieces + [z.astype(np.float64)]


def _add_products(z: np.ndarray, sums: dict[int, np.ndarray]) -> None:
    """Add ``z'z`` to ``sums``: for a power of 2^20, upper and lower halves of whole numbers."""
    for start in range(0, len(z), _ROWS):
        pieces = _pieces(z[start:start + _ROWS])
        for i, a in enumerate(pieces):
            for j, b in enumerate(pieces):
                product = (a.T @ b).astype(np.int64)
                halves = sums.setdefault(i + j, np.zeros((2, z.shape[1], z.shape[1]), np.int64))
                halves[0] += product >> 32
                halves[1] += product & _LOW


def gram(df: DataFrame, vec: str, target: Column | str, scale: int = 10_000) -> DataFrame:
    """``(i, j, g)``: the exact sums of products of all pairs of elements of ``vec``.

    The target is the element after the last one; it is in fixed point at ``scale ** 2``,
    the elements are at ``scale``.  Both triangles are there.  ``(-1, -1)`` is the number of
    rows.  All vectors must have the same length; null vectors, elements and targets fail.

    A task holds two numbers a cell, up to 4 M cells, and emits its sums once; wider vectors
    are emitted a batch at a time.  What is shuffled is a row a cell and task.
    """
    import pyarrow as pa

    fixed = F.transform(F.col(vec), lambda x: to_fixed(checked(x), scale))
    rows = df.select(
        F.when(F.col(vec).isNotNull(), fixed).otherwise(F.raise_error(F.lit("vecreduce: null vector"))).alias("x"),
        to_fixed(checked(target), scale * scale).alias("y"))

    def cells(sums: dict, width: int, count: int):
        i, j = np.indices((width, width)).reshape(2, -1)
        whole = [0] * len(i)
        for power, (high, low) in sums.items():
            whole = [w + (((h << 32) + n) << (_BITS * power))
                     for w, h, n in zip(whole, high.ravel().tolist(), low.ravel().tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)),
             pa.array([Decimal(v) for v in [*whole, count]], pa.decimal128(38, 0)),
             pa.array(np.full(len(i) + 1, width, np.int32))], names=["i", "j", "g", "width"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, width, count = {}, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0)
            lengths = np.diff(x.offsets.to_numpy())
            if lengths.min() != lengths.max() or width not in (None, lengths[0] + 1):
                raise ValueError(f"vecreduce: vectors of {lengths.min()} to {lengths.max()} elements")
            width = int(lengths[0]) + 1
            z = np.column_stack([x.flatten().to_numpy().reshape(len(lengths), width - 1), batch.column(1).to_numpy()])
            _add_products(z, sums)
            count += len(z)
            if width * width > _MOST_CELLS:
                yield cells(sums, width, count)
                sums, count = {}, 0
        if count:
            yield cells(sums, width, count)

    partial = rows.mapInArrow(fold, "i int, j int, g decimal(38,0), width int")
    total = F.try_sum("g")
    merged = partial.groupBy("i", "j").agg(
        F.when(total.isNotNull(), total).otherwise(F.raise_error(F.lit("vecreduce: a sum beyond 38 digits"))).alias("g"),
        F.min("width").alias("least"), F.max("width").alias("most"))
    differ = F.raise_error(F.concat(F.lit("vecreduce: vectors of "), F.col("least") - 1, F.lit(" to "),
                                    F.col("most") - 1, F.lit(" elements")))
    return merged.select("i", "j", F.when(F.col("least") == F.col("most"), F.col("g")).otherwise(differ).alias("g"))


def _next(cells: DataFrame, weights: DataFrame, target: int, lr: float, per_unit: float) -> DataFrame:
    """The weights after one more iteration, with their history.

    The target takes part as an element of weight -1 that stays, so one join and one
    aggregate give ``X'X w - X'y`` and the weights themselves.
    """
    wide = F.try_multiply(F.col("g"), F.col("w").cast("decimal(19,0)")).cast("decimal(38,0)")
    known = F.when(wide.isNotNull(), wide).otherwise(F.raise_error(F.lit("vecreduce: a product beyond 38 digits")))
    own = F.col("i") == F.col("j")
    slope = F.try_sum(known)
    stepped = cells.join(weights.withColumnRenamed("dim", "j"), "j").groupBy("i").agg(
        F.when(slope.isNotNull(), slope).otherwise(F.raise_error(F.lit("vecreduce: a sum beyond 38 digits")))
        .cast("double").alias("slope"),
        F.max(F.when(own, F.col("w"))).alias("w"), F.max(F.when(own, F.col("history"))).alias("history"))
    exact = F.col("w").cast("double") - F.lit(float(lr)) * (F.col("slope") / F.lit(per_unit)) + F.lit(0.5)
    moved = F.when(F.abs(exact) < F.lit(_LIMIT), F.floor(exact).cast("long")).otherwise(
        F.raise_error(F.lit("vecreduce: a weight out of range; use a smaller learning rate")).cast("long"))
    new = stepped.select(F.col("i").alias("dim"), "history",
                         F.when(F.col("i") == target, F.lit(-1)).otherwise(moved).cast("long").alias("w"))
    return new.select("dim", "w", F.concat("history", F.array("w")).alias("history"))


def descend_on_gram(df: DataFrame, vec: str, target: Column | str, lr: float, iterations: int, scale: int = 10_000,
                    cut_every: int = 8) -> DataFrame:
    """Batch gradient descent on the mean squared error: the weights after every iteration,
    ``(iter, dim, w)``, from 0 on.

    One pass over the data; iterations join the stored sums with the weights.  Features and
    weights are fixed point at ``scale``, sums are exact and weights are rounded after each
    step, so the result depends neither on partitioning nor on the engine.  Weights are a
    relation, written every ``cut_every`` iterations, so no plan grows with them.  A null,
    a sum beyond 38 digits or a weight out of range fails in any session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "gram")
    gram(df, vec, target, scale).write.parquet(path)
    stored = spark.read.schema("i int, j int, g decimal(38,0)").parquet(path)
    size = stored.where("i = -1").agg(F.max("g")).first()[0]
    none = spark.createDataFrame([], "iter int, dim int, w double")
    if size is None:
        return none
    cells = stored.where("i >= 0")
    last = cells.agg(F.max("i")).first()[0]
    per_unit = float(int(size)) * float(scale) * float(scale)
    weights = cells.where("i = j").select(
        F.col("i").alias("dim"), F.when(F.col("i") == last, F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("w"),
        F.array().cast("array<bigint>").alias("history"))
    for done in range(1, iterations + 1):
        weights = _next(cells, weights, last, lr, per_unit)
        if done % cut_every == 0 and done < iterations:
            path = scratch_path(spark, "gram-weights")
            weights.write.parquet(path)
            weights = spark.read.schema("dim int, w long, history array<bigint>").parquet(path)
    found = weights.where(F.col("dim") != last).select("dim", F.posexplode("history").alias("at", "w"))
    return found.select((F.col("at") + 1).alias("iter"), "dim", (F.col("w").cast("double") / F.lit(float(scale))).alias("w"))

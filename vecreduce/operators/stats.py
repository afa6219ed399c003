"""Gradient / loss / count statistics in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_point import EMBEDDING_SCALE, col_of, exact_sum, product_sum, to_fixed, wide_sum
from .blocks import block_stats, blocks_to_dims


def _is_integral(df: DataFrame, c) -> bool:
    dtype = df.select(col_of(c).alias("_t")).schema["_t"].dataType
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0)


def tree_stats(df: DataFrame, grads: Mapping[str, Column | str],
               loss: Column | str | tuple[Column | str, Column | str],
               loss_name: str = "loss", count_name: str = "cnt",
               loss_scale: int | None = None) -> DataFrame:
    """``(grad_1..grad_k, loss, cnt)`` in one pass.

    The reference's tree-shaped merge of ``(gradient, loss, count)`` is what
    Spark's partial/final aggregation already does: each task folds its rows
    into one buffer and the buffers are merged after one small exchange.
    Gradient columns are summed as given (pass fixed-point BIGINTs for exact
    totals).  The loss is summed exactly when it is integral (``wide_sum``:
    no BIGINT overflow), when it is a pair of integral factors, whose products are
    summed, or when ``loss_scale`` is given (fixed point at that scale); otherwise it
    is a plain double sum.
    """
    aggs = [exact_sum(c).alias(name) for name, c in grads.items()]
    if isinstance(loss, tuple):
        total = product_sum(*loss).cast("double")
    elif loss_scale:
        total = wide_sum(to_fixed(loss, loss_scale)) / F.lit(float(loss_scale))
    elif _is_integral(df, loss):
        total = wide_sum(loss)
    else:
        total = F.sum(col_of(loss).cast("double"))
    aggs.append(total.alias(loss_name))
    aggs.append(F.count(F.lit(1)).alias(count_name))
    return df.agg(*aggs)


def gradient_stats(df: DataFrame, vec: str, loss: Column | str, scale: int = EMBEDDING_SCALE,
                   loss_scale: int = EMBEDDING_SCALE, on_invalid: str = "error") -> DataFrame:
    """The vector triple, one row per element: ``(dim, grad, loss, cnt)``.

    ``grad`` is the element's total in fixed point; ``loss`` (a double) and ``cnt`` are of
    all rows, the same in each row of the result.  The merge is :func:`block_stats`: one
    aggregate by block, whose one row of loss and count is joined back.
    """
    blocks = block_stats(df, vec, loss, scale=scale, loss_scale=loss_scale, on_invalid=on_invalid)
    return blocks_to_dims(blocks, "grad", keep=("loss", "cnt")).select("dim", "grad", "loss", "cnt")


def vector_stats(long: DataFrame, value: str = "g") -> DataFrame:
    """Per-element totals, squared norm and row count of long-form cells: one row per ``dim``.

    For vectors too wide for one aggregate row: the merge is hash-partitioned
    by ``dim`` instead of funnelled into one buffer.
    """
    return long.groupBy("dim").agg(exact_sum(value).alias("total"),
                                   product_sum(value, value).cast("double").alias("sq"),
                                   F.count(F.lit(1)).alias("cnt"))

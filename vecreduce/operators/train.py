"""Data-parallel gradient descent on DataFrames.

* :func:`gd_step` / :func:`gd_trajectory`: gradients that do not depend on
  the weights (the reference's setting).  Then ``w_k = w0 - lr * (sum of
  mean gradients up to k)``, which is one cumulative window: no driver loop.
* :func:`ls_gradient` / :func:`ls_fit`: least-squares, where the gradient
  does depend on ``w``: one aggregate at given weights, or a whole fit on the
  exact sums of products of one pass.
"""

from __future__ import annotations

import operator

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_point import (CENTS, EMBEDDING_SCALE, checked, col_of, exact_sum, exact_sum_over, from_fixed,
                                     product_sum, to_fixed)
from ..functions.ring import worker_of
from .gram import descend_on_gram
from .reduce import all_reduce


def event_cells(events: DataFrame, n: int = 8, scale: int = CENTS, on_invalid: str = "error") -> DataFrame:
    """One gradient cell per event: ``(iter, worker, event_type, g)``.

    ``iter`` = day of the event (days since 1970-01-01), ``worker`` = user id
    mod ``n``, element = event type, ``g`` = value in fixed point.  A null, NaN or infinite
    value fails, counts as zero or is skipped, as in ``to_long``; an event without a user or
    a time fails wherever those are used, or is left out.
    """
    day, worker = F.unix_date(F.to_date("ts")), worker_of("user_id", n)
    if on_invalid == "error":
        missing = F.raise_error(F.lit("vecreduce: event without a user or a time"))
        day = F.when(day.isNotNull(), day).otherwise(missing)
        worker = F.when(worker.isNotNull(), worker).otherwise(missing)
    else:
        events = events.where("user_id is not null and ts is not null")
    return events.select(day.alias("iter"), worker.alias("worker"), "event_type",
                         to_fixed(checked("value", on_invalid), scale).alias("g"))


def event_gradients(events: DataFrame, n: int = 8, scale: int = CENTS, on_invalid: str = "error") -> DataFrame:
    """Per-iteration, per-worker gradients: :func:`event_cells` summed per worker."""
    cells = event_cells(events, n, scale, on_invalid)
    return cells.groupBy("iter", "worker", "event_type").agg(exact_sum("g").alias("g"))


def gd_step(totals: DataFrame, lr: float, n: int, scale: int = EMBEDDING_SCALE,
            total: str = "total", w0: DataFrame | None = None) -> DataFrame:
    """One update ``w = w0 - lr * total / n``: ``(dim, w)``; ``w0`` defaults to ones.

    ``w0`` is a table ``(dim, w)`` with exactly the elements of ``totals``: an element that
    one of them lacks fails, nothing is cut off.
    """
    y = from_fixed(total, scale)
    if w0 is None:
        return totals.select("dim", (F.lit(1.0) - F.lit(float(lr)) * y / F.lit(float(n))).alias("w"))
    both = totals.join(w0.select("dim", F.col("w").cast("double").alias("_w0")), "dim", "full")
    w = F.col("_w0") - F.lit(float(lr)) * y / F.lit(float(n))
    return both.select("dim", F.when(F.col("_w0").isNotNull() & F.col(total).isNotNull(), w).otherwise(
        F.raise_error(F.lit("vecreduce: weights and totals have different elements"))).alias("w"))


def gd_trajectory(grads: DataFrame, lr: float, n: int, scale: int, w0: float = 1.0,
                  it: str = "iter", dim: str = "dim", value: str = "g") -> DataFrame:
    """Weights after every iteration: ``(iter, dim, w)``.

    ``grads`` holds cells ``(iter, [worker,] dim, g)`` in fixed point, summed
    per worker or raw (raw cells skip one exchange).  All-reduce per
    ``(iter, dim)``, then a running sum over ``iter`` per ``dim`` (exact,
    BIGINT) and one division at the end.
    """
    totals = all_reduce(grads, by=[it], dim=dim, value=value, name="total")
    run = exact_sum_over("total", Window.partitionBy(dim).orderBy(it)
                         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w = F.lit(float(w0)) - F.lit(float(lr)) * (run.cast("double") / F.lit(float(scale * n)))
    return totals.select(it, dim, w.alias("w"))


def ls_gradient(df: DataFrame, features: Sequence[Column | str], target: Column | str,
                w: Sequence, exact: bool = False, names: Sequence[str] | None = None,
                on_invalid: str = "error") -> DataFrame:
    """Least-squares gradient ``sum x * (x.w - y)``, squared error and count, one row.

    ``exact=True`` needs integer features, target and weights: a row's error is a BIGINT
    and fails beyond it, every sum of products is exact and rounded to DOUBLE once, so the
    result does not depend on partitioning.  A row with a null feature or target fails, or
    is left out of sums and count with ``on_invalid="skip"``.
    """
    names = list(names or [f"g{i}" for i in range(len(features))])
    xs = [col_of(c) for c in features]
    if exact:
        probe = df.select(*[x.alias(f"_p{i}") for i, x in enumerate(xs)],
                          col_of(target).alias("_py")).schema
        bad = [f.name for f in probe.fields if not isinstance(
            f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
        if bad:
            raise ValueError("exact=True needs integral features and target (use to_fixed); "
                             f"got non-integral {bad}")
        xs = [x.cast("long") for x in xs]
        y = col_of(target).cast("long")
        wl = [F.lit(int(v)).cast("long") for v in w]
    else:
        xs = [x.cast("double") for x in xs]
        y = col_of(target).cast("double")
        wl = [F.lit(float(v)) for v in w]
    named = df.select(*[x.alias(f"_x{i}") for i, x in enumerate(xs)], y.alias("_y"))
    known = F.lit(True)
    for c in named.columns:
        known = known & F.col(c).isNotNull()
    if on_invalid == "skip":
        named = named.where(known)
    elif on_invalid != "error":
        raise ValueError(f"on_invalid must be error or skip, not {on_invalid!r}")
    times, plus, minus = ((F.try_multiply, F.try_add, F.try_subtract) if exact
                          else (operator.mul, operator.add, operator.sub))
    pred = None
    for i, wi in enumerate(wl):
        term = times(F.col(f"_x{i}"), wi)
        pred = term if pred is None else plus(pred, term)
    err = minus(pred, F.col("_y"))
    base = named.withColumn("_err", F.when(err.isNotNull(), err).otherwise(
        F.raise_error(F.lit("vecreduce: null feature or target, or an error beyond BIGINT"))))

    def total(a, b):
        return product_sum(a, b).cast("double") if exact else F.sum(F.col(a) * F.col(b))

    aggs = [total(f"_x{i}", "_err").alias(nm) for i, nm in enumerate(names)]
    aggs += [total("_err", "_err").alias("sse"), F.count(F.lit(1)).alias("cnt")]
    return base.agg(*aggs)


def ls_fit(df: DataFrame, vec: str, target: Column | str, lr: float, iterations: int,
           scale: int = 10_000) -> DataFrame:
    """Batch gradient descent on the mean squared error over all elements of ``vec``.

    Returns the weights after every iteration, ``(iter, dim, w)``; they start at 0.  All
    vectors must have the same length; null vectors, elements and targets fail.  One pass
    over the data, see :mod:`.gram`.
    """
    return descend_on_gram(df, vec, target, lr, iterations, scale)

"""Keyed sums and the all-reduce family on long-form cells.

Plan shape (checked with ``explain``): raw cells -> partial HashAggregate in
the scan stage -> exchange of at most ``tasks x workers x dims`` rows ->
final aggregate.  Scatter-reduce and the gathers work on sums they make
themselves, so their exchange moves ``workers x dims`` rows, never raw data,
and a group never holds more than one row per worker.  They return a row for
every one of the ``n`` workers and every element that any worker has: a worker
without a cell counts as zero and still receives the totals.  Nothing is joined
pairwise and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_point import EMBEDDING_SCALE, exact_sum, exact_sum_over, wide_sum
from ..functions.ring import ring_pos
from .layout import local_sums, to_long, with_groups


def keyed_sum(df: DataFrame, key, value: str, name: str = "total") -> DataFrame:
    """Sum of ``value`` per key (the reference's map accumulator ``add``).

    Catalyst runs it as partial + final hash aggregation; a hot key costs
    one partial row per task, so skew does not reach the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(exact_sum(value).alias(name))


def with_default(keys: DataFrame, totals: DataFrame, key: str, value: str = "total",
                 default=0) -> DataFrame:
    """Every key of ``keys`` with its total, ``default`` (0) when absent.

    A left join; Spark picks broadcast (AQE, behind
    ``spark.sql.autoBroadcastJoinThreshold``) or sort-merge by measured size.
    """
    return (keys.select(key).join(totals.select(key, value), key, "left")
                .select(key, F.coalesce(F.col(value), F.lit(default)).alias(value)))


def keyed_set(df: DataFrame, key, value: str, order: Sequence[str], name: str | None = None) -> DataFrame:
    """Last write wins: per key, ``value`` of the row with the greatest ``order``.

    ``order`` must make rows unique within a key (e.g. ``(ts, event_id)``),
    otherwise "last" is not defined.  ``max_by`` aggregates partially per
    task, so a hot key does not collect its rows into one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(name or value))


def all_reduce(long: DataFrame, by: Sequence[str] = (), dim: str = "dim", value: str = "g",
               name: str = "total", wide: bool = False) -> DataFrame:
    """Element-wise sum of all workers' vectors: ``([by...,] dim, total)``.

    The BIGINT total holds up to 9.2e18 fixed-point units (9.2e12 in value
    at the default scale); beyond that it fails rather than wraps.
    ``wide=True`` accumulates with :func:`wide_sum` instead: exact for any
    total, returned as DOUBLE, at the cost of three sums per cell.
    """
    total = wide_sum(value) if wide else exact_sum(value)
    return long.groupBy(*by, dim).agg(total.alias(name))


def _in_ring(cells: DataFrame, n: int, value: str) -> DataFrame:
    """``cells``, failing at a worker outside ``[0, n)`` instead of leaving it out."""
    w = F.col("worker")
    return cells.withColumn(value, F.when((w >= 0) & (w < n), F.col(value)).otherwise(
        F.raise_error(F.lit(f"vecreduce: worker outside the ring of {n}"))))


def _workers(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("worker")


def _zero_entries(n: int, of: str):
    """An entry of value 0 for each of ``n``, told from the others by ``every``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(
        k.alias(of), F.lit(True).alias("every"), F.lit(0).cast("long").alias("v")))


def _ring_size(n: int, group_size: int | None) -> int:
    size = group_size or n
    if n < 1 or n % size:
        raise ValueError(f"{n} workers do not make whole groups of {size}")
    return size


def scatter_reduce(cells: DataFrame, n: int, group_size: int | None = None, value: str = "g",
                   name: str = "partial", by: Sequence[str] = ()) -> DataFrame:
    """Ring scatter-reduce as a running sum.

    After the scatter-reduce, worker ``p`` holds, for element ``dim``,
    the sum of the workers from the element's owner round the ring to ``p``:
    ``sum(g) over (partition by [grp,] dim order by ring_pos)``.

    ``cells`` are ``(worker, dim, g)`` rows, raw or already summed: they are
    summed per ``(worker, dim)`` first.  An element's sums then meet in one array of at most
    ``n`` entries, a zero entry for each worker is put behind them, and one scan in ring
    order gives the zero entries the sums up to them, so the work is linear in ``n``.
    With ``group_size`` a ring runs inside each block of workers.  ``by`` adds
    independent rings, e.g. ``by=["iter"]`` for one all-reduce per
    iteration of gradient descent.
    Returns ``([by...,] [grp,] worker, dim, ring_pos, partial)``.
    """
    size = _ring_size(n, group_size)
    by = list(by)
    local = local_sums(_in_ring(cells, n, value), by=[*by, "worker", "dim"], value=value)
    per_dim = local.groupBy(*by, "dim").agg(F.collect_list(F.struct(
        "worker", F.lit(False).alias("every"), F.col(value).alias("v"))).alias("_own"))
    grid = per_dim.select(*by, "dim", F.inline(F.concat("_own", _zero_entries(n, "worker"))))
    grid = with_groups(grid, size).withColumn("ring_pos", ring_pos("local_worker", "dim", size))
    run = exact_sum_over("v", Window.partitionBy(*by, "dim", "grp").orderBy("ring_pos", "every").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    cols = by + (["grp"] if group_size else []) + ["worker", "dim", "ring_pos"]
    return grid.withColumn(name, run).where("every").select(*cols, name)


def all_gather(cells: DataFrame, n: int, value: str = "g", name: str = "total",
               by: Sequence[str] = ()) -> DataFrame:
    """Every one of ``n`` workers with every element's total: ``([by...,] worker, dim, total)``.

    Totals are made once per element and then repeated for each worker, without a join.
    """
    totals = all_reduce(_in_ring(cells, n, value), by, value=value, name=name)
    return totals.select(*by, _workers(n), "dim", name)


def group_all_reduce(cells: DataFrame, group_size: int, value: str = "g",
                     name: str = "grp_total", by: Sequence[str] = ()) -> DataFrame:
    """Totals inside each block of workers: ``([by...,] grp, dim, grp_total)``."""
    return all_reduce(with_groups(cells, group_size), by=[*by, "grp"], value=value, name=name)


def group_all_gather(cells: DataFrame, group_size: int, n: int, value: str = "g",
                     name: str = "grp_total", by: Sequence[str] = ()) -> DataFrame:
    """Every one of ``n`` workers with its group's total of every element: ``(grp, worker, dim, grp_total)``.

    A group none of whose workers has the element holds zero.
    """
    size = _ring_size(n, group_size)
    by = list(by)
    totals = group_all_reduce(_in_ring(cells, n, value), size, value, name, by)
    per_dim = totals.groupBy(*by, "dim").agg(F.collect_list(F.struct(
        "grp", F.lit(False).alias("every"), F.col(name).alias("v"))).alias("_groups"))
    grid = per_dim.select(*by, "dim", F.inline(F.concat("_groups", _zero_entries(n // size, "grp"))))
    whole = grid.groupBy(*by, "dim", "grp").agg(exact_sum("v").alias(name))
    first = F.col("grp") * size
    return whole.select(*by, "grp", F.explode(F.sequence(first, first + size - 1)).alias("worker"), "dim", name)


def cross_group_merge(cells: DataFrame, group_size: int, n: int, value: str = "g", name: str = "total",
                      by: Sequence[str] = ()) -> DataFrame:
    """Every worker after the cross-group merge: ``(grp, worker, dim, total)``.

    Adding the other groups' totals to a group's own gives every worker of every group the
    global total.
    """
    size = _ring_size(n, group_size)
    gathered = with_groups(all_gather(cells, n, value, name, by), size)
    return gathered.select(*by, "grp", "worker", "dim", name)


def merge_groups(group_totals: DataFrame, value: str = "grp_total", name: str = "total",
                 by: Sequence[str] = ()) -> DataFrame:
    """Cross-group merge: add the other groups' totals to each group's, any group count.

    ``group_totals`` has one row per ``(grp, dim)`` (the output of
    :func:`group_all_reduce`), so a window partition holds one row per group.
    """
    return group_totals.withColumn(name, exact_sum_over(value, Window.partitionBy(*by, "dim")))


def hierarchical_all_reduce(cells: DataFrame, group_size: int, value: str = "g",
                            method: str = "window", by: Sequence[str] = ()) -> DataFrame:
    """Two-level all-reduce: ``(grp, dim, grp_total, total)``; ``total`` equals :func:`all_reduce`.

    ``method="window"``: group totals, then a window sum per ``dim``.
    ``method="rollup"``: both levels from one grouping-sets aggregate over
    ``(dim, grp)`` and ``(dim)`` (each cell is expanded twice in the scan
    stage, so the window method is the default).
    """
    by = list(by)
    if method == "window":
        return merge_groups(group_all_reduce(cells, group_size, value, by=by), by=by)
    if method == "rollup":
        g = with_groups(cells, group_size)
        both = g.groupingSets([(*by, "dim", "grp"), (*by, "dim")], *by, "dim", "grp").agg(
            exact_sum(value).alias("s"), F.grouping("grp").alias("lvl"))
        tot = F.max(F.when(F.col("lvl") == 1, F.col("s"))).over(Window.partitionBy(*by, "dim"))
        return (both.withColumn("total", tot).where(F.col("lvl") == 0)
                    .select(*by, "grp", "dim", F.col("s").alias("grp_total"), "total"))
    raise ValueError("method must be 'window' or 'rollup'")


def sparse_all_reduce(df: DataFrame, vec: str = "features", scale: int = EMBEDDING_SCALE,
                      by: Sequence[str] = (), on_invalid: str = "error") -> DataFrame:
    """Element-wise sum of Spark ML vectors over their stored entries: ``([by...,] dim, total, support)``.

    ``support`` is how many vectors store the element, zeros included.  A sparse vector
    gives its stored entries only, so work and shuffle grow with entries and not with the
    vectors' length; an element that no vector stores has no row.
    """
    rows = df.select(*by, vec, F.lit(0).alias("_worker"))
    cells = to_long(rows, vec, worker="_worker", scale=scale, on_invalid=on_invalid, keep=by)
    return cells.groupBy(*by, "dim").agg(exact_sum("g").alias("total"), F.count("g").alias("support"))

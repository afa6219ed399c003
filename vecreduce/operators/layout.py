"""Layouts: vectors per row <-> long ``(worker, dim, g)`` cells.

The long form is the layout every reduction works on: one row per element,
its value as an exact fixed-point BIGINT.  ``posexplode`` runs inside the
scan's whole-stage-codegen span and feeds a partial (map-side) aggregate
directly, so a task emits at most ``workers x dims`` rows whatever its
input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_point import EMBEDDING_SCALE, checked, exact_sum, to_fixed
from ..functions.ring import group_of, local_worker, worker_of


def to_long(df: DataFrame, vec: str = "embedding", key: str | None = "vec_id", n: int = 8,
            worker: str | None = None, scale: int = EMBEDDING_SCALE, on_invalid: str = "error",
            keep: Sequence[str] = ()) -> DataFrame:
    """``(worker, dim, g)`` with ``g = floor(x * scale + 0.5)``.

    The worker is an existing ``worker`` column or ``key mod n``.  Any number of
    rows may belong to one worker (they are summed later).  A row without a
    worker key raises under ``on_invalid="error"`` wherever the worker is
    used (Catalyst prunes the check from a plain all-reduce, where the key is
    irrelevant) and is dropped under ``"zero"`` / ``"skip"``.  ``vec`` may be an
    array column or a Spark ML vector; a sparse vector gives cells for its stored
    entries only.
    """
    w = F.col(worker).cast("int") if worker else worker_of(key, n)
    v = F.col(vec)
    stored = type(df.schema[vec].dataType).__name__ == "VectorUDT"
    if stored:
        v = F.unwrap_udt(v)
    if on_invalid == "error":
        # a null vector or worker key is an error too; with "zero" / "skip" the row
        # contributes nothing
        v = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit("vecreduce: null vector")))
        w = F.when(w.isNotNull(), w).otherwise(F.raise_error(F.lit("vecreduce: null worker key")))
    else:
        df = df.where(w.isNotNull())
    if stored:
        entries = F.when(v["type"] == 0, F.map_from_arrays(v["indices"], v["values"])).otherwise(
            F.map_from_arrays(F.sequence(F.lit(0), F.size(v["values"]) - 1), v["values"]))
        entries = F.when((v["type"] == 0) | (F.size(v["values"]) > 0), entries)
        cells = df.select(*keep, w.alias("worker"), F.explode(entries).alias("dim", "x"))
    else:
        cells = df.select(*keep, w.alias("worker"), F.posexplode(v).alias("dim", "x"))
    return cells.select(*keep, "worker", "dim",
                        to_fixed(checked("x", on_invalid), scale).alias("g"))


def local_sums(long: DataFrame, by: Sequence[str] = ("worker", "dim"), value: str = "g") -> DataFrame:
    """Pre-sum cells per ``(worker, dim)``: a worker's vector, whatever its row count."""
    return long.groupBy(*by).agg(exact_sum(value).alias(value))


def with_groups(df: DataFrame, group_size: int, worker: str = "worker") -> DataFrame:
    """Add ``grp`` (block of ``group_size`` workers) and ``local_worker`` (rank in block)."""
    return df.withColumns({"grp": group_of(worker, group_size),
                           "local_worker": local_worker(worker, group_size)})


def assemble(long: DataFrame, keys: Sequence[str], dim: str = "dim", value: str = "g",
             name: str = "vec", dense: bool = False) -> DataFrame:
    """Rebuild one array per key from its cells, ordered by ``dim``.

    Cells are summed per ``(keys, dim)`` first, so a group collects exactly
    one entry per element: the list is bounded by the vector length, not by
    the number of input rows.  Array positions follow the sorted ``dim``
    values; with ``dense=True`` a group whose dims are not exactly
    ``0..k-1`` fails instead of shifting elements to the wrong positions.
    """
    if not keys:
        raise ValueError("assemble needs keys: without them one task would hold everything")
    summed = long.groupBy(*keys, dim).agg(exact_sum(value).alias(value))
    cells = F.array_sort(F.collect_list(F.struct(F.col(dim).alias("d"), F.col(value).alias("v"))))
    vec = cells.getField("v")  # field of every struct in the array (no lambda)
    if dense:
        k = F.count(F.lit(1))
        ok = (k == 0) | ((F.min(dim) == 0) & (F.max(dim) == k - 1))
        vec = F.when(ok, vec).otherwise(F.raise_error(F.lit(
            "vecreduce: dims are not 0..k-1; a dense vector would misplace elements")))
    return summed.groupBy(*keys).agg(vec.alias(name))


def explode_vector(df: DataFrame, vec: str = "vec", keys: Sequence[str] = (), dim: str = "dim",
                   value: str = "v") -> DataFrame:
    """Inverse of :func:`assemble`: one row per element."""
    return df.select(*keys, F.posexplode(vec).alias(dim, value))

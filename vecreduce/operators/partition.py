"""Partition-level user functions and caching.

``map_partitions_sum`` is the user-function form of the all-reduce: each
task folds its rows into one partial vector per worker with numpy over
Arrow batches (``mapInArrow``; no per-row Python), then Spark's hash
aggregate merges partials by element.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_point import EMBEDDING_SCALE, exact_sum
from ..functions.ring import worker_of

_LONG_SCHEMA = "worker int, dim int, g long"

# The task-side functions below travel with the job (pickled by value), so
# executors need numpy / pandas / pyarrow but not this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _fixed(values: np.ndarray, scale: int) -> np.ndarray:
    # Same IEEE steps and range check as functions.fixed_point.to_fixed.
    v = values.astype(np.float64) * float(scale) + 0.5
    if v.size and not (np.abs(v) < 9.2e18).all():
        raise ValueError("vecreduce: value out of fixed-point range; use a smaller scale")
    return np.floor(v).astype(np.int64)


def _flat_cells(vec, scale: int, on_invalid: str):
    """Arrow list column -> (kept-row mask, lengths, fixed-point values), no per-row Python.

    ``"zero"`` and ``"skip"`` both add nothing for an invalid element here:
    the partial sums cannot tell a skipped element from a zero one.
    """
    import pyarrow.compute as pc

    if on_invalid not in ("error", "zero", "skip"):
        raise ValueError(f"on_invalid must be error, zero or skip, not {on_invalid!r}")

    keep = None
    if vec.null_count:
        if on_invalid == "error":
            raise ValueError("vecreduce: null vector")
        keep = pc.is_valid(vec).to_numpy(zero_copy_only=False)
        vec = vec.filter(pc.is_valid(vec))
    offsets = vec.offsets.to_numpy()
    lengths = np.diff(offsets)
    flat = vec.flatten()
    if flat.null_count:
        if on_invalid == "error":
            raise ValueError("vecreduce: null, NaN or infinite vector element")
        flat = pc.fill_null(flat, 0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(values)
    if bad.any():
        if on_invalid == "error":
            raise ValueError("vecreduce: null, NaN or infinite vector element")
        values = np.where(bad, 0.0, values)
    return keep, lengths, _fixed(values, scale)


_LIMB = 32


def _fold_arrow(workers: np.ndarray, lengths: np.ndarray, fixed: np.ndarray, acc: dict) -> None:
    """Add one batch's vectors into per-worker partial sums, without padding.

    A worker has two int64 sums for each element, of its values' upper and lower 32 bits,
    each exact for two billion values.
    """
    at = np.arange(len(fixed)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    of_worker = np.repeat(workers, lengths)
    for w in np.unique(workers).tolist():
        mine = of_worker == w
        places, values = at[mine], fixed[mine]
        width = int(places.max(initial=-1)) + 1
        sums = acc.get(w)
        if sums is None or sums.shape[1] < width:
            grown = np.zeros((2, width), dtype=np.int64)
            if sums is not None:
                grown[:, :sums.shape[1]] = sums
            sums = acc[w] = grown
        np.add.at(sums[0], places, values >> _LIMB)
        np.add.at(sums[1], places, values & ((1 << _LIMB) - 1))


def _joined(sums: np.ndarray) -> list[int]:
    """The sums as whole numbers; beyond BIGINT they fail."""
    whole = [(hi << _LIMB) + lo for hi, lo in zip(*sums.tolist())]
    if any(not -(1 << 63) <= v < 1 << 63 for v in whole):
        raise OverflowError("vecreduce: partial sum exceeds BIGINT; use a smaller scale")
    return whole


def map_partitions_sum(df: DataFrame, vec: str = "embedding", key: str = "vec_id", n: int = 8,
                       scale: int = EMBEDDING_SCALE, on_invalid: str = "error") -> DataFrame:
    """Per-partition partial sums with numpy over Arrow batches, merged by Spark: ``(dim, total)``.

    The list column is flattened zero-copy into one numpy array per batch;
    no Python object is created per row.  No shuffle before the
    function; each task emits at most ``workers x dims`` rows, and the final
    sum per ``dim`` is a hash aggregate.
    """
    rows = df.select(worker_of(key, n).alias("worker"), F.col(vec).alias("vec"))

    def fold(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        acc: dict = {}
        for rb in batches:
            if rb.num_rows == 0:
                continue
            if rb.column(0).null_count:  # rows without a worker key
                if on_invalid == "error":
                    raise ValueError("vecreduce: null worker key")
                rb = rb.filter(pc.is_valid(rb.column(0)))
            keep, lengths, fixed = _flat_cells(rb.column(1), scale, on_invalid)
            workers = rb.column(0).to_numpy(zero_copy_only=False)
            if keep is not None:
                workers = workers[keep]
            _fold_arrow(workers, lengths, fixed, acc)
        if not acc:
            return
        w_col, d_col, g_col = [], [], []
        for w, sums in acc.items():
            part = _joined(sums)
            w_col.append(np.full(len(part), w, dtype=np.int32))
            d_col.append(np.arange(len(part), dtype=np.int32))
            g_col.append(np.array(part, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(w_col)), pa.array(np.concatenate(d_col)),
             pa.array(np.concatenate(g_col))], names=["worker", "dim", "g"])

    partials = rows.mapInArrow(fold, _LONG_SCHEMA)
    return partials.groupBy("dim").agg(exact_sum("g").alias("total"))


def cache_count(df: DataFrame, storage: str = "memory_and_disk") -> tuple[DataFrame, int]:
    """Persist, materialise with ``count()`` and count again from the stored copy.

    Returns the stored DataFrame, for the caller to use and to ``unpersist()``, and the
    count.  ``storage="disk"`` keeps a table far larger than executor memory on the
    executors' disks instead of evicting and recomputing it.
    """
    from pyspark import StorageLevel

    levels = {"memory_and_disk": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}
    if storage not in levels:
        raise ValueError(f"storage must be one of {sorted(levels)}")
    stored = df.persist(levels[storage])
    stored.count()
    return stored, stored.count()

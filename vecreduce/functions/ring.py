"""Ring index arithmetic as column expressions.

In a ring of ``n`` workers, worker ``p`` works on chunk ``(p - t) mod n`` at
step ``t``.  The inverse, ``ring_pos = (p - dim) mod n``, is the step at
which worker ``p`` touches element ``dim``; it is also the position of ``p``
in the ring that starts at the element's owner.  Addressing chunks by
``dim mod n`` covers vectors of any length (two stripes per worker when the
length is ``2n`` is a special case).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_point import col_of


def ring_pos(worker, dim, n: int) -> Column:
    """Step at which ``worker`` touches element ``dim``: ``(p - dim) mod n``."""
    return F.pmod(col_of(worker) - col_of(dim), F.lit(n)).cast("int")


def worker_of(key, n: int) -> Column:
    """Assign a row to one of ``n`` workers by a non-negative integer key."""
    return F.pmod(col_of(key), F.lit(n)).cast("int")


def group_of(worker, group_size: int) -> Column:
    """Group of a worker when workers are split into blocks of ``group_size``."""
    return F.floor(col_of(worker) / F.lit(group_size)).cast("int")


def local_worker(worker, group_size: int) -> Column:
    """Position of a worker inside its group."""
    return F.pmod(col_of(worker), F.lit(group_size)).cast("int")

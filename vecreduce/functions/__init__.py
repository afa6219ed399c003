"""Column-level building blocks (all JVM-side expressions, no Python UDFs)."""

from .fixed_point import (CENTS, EMBEDDING_SCALE, checked, exact_sum, exact_sum_over, from_fixed, product_sum,
                          to_fixed, wide_sum)
from .ring import group_of, local_worker, ring_pos, worker_of

__all__ = [
    "CENTS", "EMBEDDING_SCALE", "checked", "exact_sum", "exact_sum_over", "from_fixed", "product_sum",
    "to_fixed", "wide_sum",
    "group_of", "local_worker", "ring_pos", "worker_of",
]

"""Window formulation vs its closed form (brute force, small inputs).

In a ring of ``n``, after the scatter-reduce worker ``p`` holds of element ``c`` the values of the
workers ``c, c + 1, .., p`` (mod n); after the gather everyone holds the column's total.
"""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vecreduce import operators as op
from vecreduce.sources import matrix_literal, synthetic_gradients


def scattered(v: np.ndarray) -> np.ndarray:
    n, m = v.shape
    return np.array([[sum(v[(c + s) % n][c] for s in range((p - c) % n + 1)) for c in range(m)] for p in range(n)])


def cells(spark, v):
    return op.to_long(matrix_literal(spark, v.tolist()), "vec", worker="worker", scale=1)


def as_matrix(rows, shape, value):
    out = np.full(shape, -10 ** 9)
    for r in rows:
        out[r.worker][r.dim] = r[value]
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 6), extra=st.integers(0, 9), seed=st.integers(0, 10_000))
def test_ring_equals_closed_form(spark, n, extra, seed):
    v = np.random.default_rng(seed).integers(-100, 100, size=(n, n + extra))
    local = cells(spark, v)
    assert (as_matrix(op.scatter_reduce(local, n).collect(), v.shape, "partial") == scattered(v)).all()
    assert (as_matrix(op.all_gather(local, n).collect(), v.shape, "total") == v.sum(axis=0)).all()


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(group_size=st.integers(1, 4), groups=st.integers(1, 3), extra=st.integers(0, 6), seed=st.integers(0, 10_000))
def test_groups_equal_closed_form(spark, group_size, groups, extra, seed):
    n = group_size * groups
    v = np.random.default_rng(seed).integers(-100, 100, size=(n, group_size + extra))
    local = cells(spark, v)
    blocks = [v[g:g + group_size] for g in range(0, n, group_size)]
    got = as_matrix(op.scatter_reduce(local, n, group_size=group_size).collect(), v.shape, "partial")
    assert (got == np.vstack([scattered(b) for b in blocks])).all()
    got = as_matrix(op.group_all_gather(local, group_size, n).collect(), v.shape, "grp_total")
    assert (got == np.vstack([np.tile(b.sum(axis=0), (group_size, 1)) for b in blocks])).all()
    got = as_matrix(op.cross_group_merge(local, group_size, n).collect(), v.shape, "total")
    assert (got == v.sum(axis=0)).all()


def test_operators_by_iteration(spark):
    """by=["iter"] equals running each iteration on its own, for every operator."""
    grads = synthetic_gradients(spark, iterations=3, workers=8, dims=6, seed=4)
    grads = grads.withColumn("g", grads.g.cast("long"))
    calls = {
        "scatter": lambda c, **k: op.scatter_reduce(c, 8, **k),
        "group_scatter": lambda c, **k: op.scatter_reduce(c, 8, group_size=4, **k),
        "all_gather": lambda c, **k: op.all_gather(c, 8, **k),
        "group_all_gather": lambda c, **k: op.group_all_gather(c, 4, 8, **k),
        "cross_group_merge": lambda c, **k: op.cross_group_merge(c, 4, 8, **k),
        "hierarchical": lambda c, **k: op.hierarchical_all_reduce(c, 4, **k),
        "hierarchical_rollup": lambda c, **k: op.hierarchical_all_reduce(c, 4, method="rollup", **k),
    }
    for name, call in calls.items():
        together = sorted(tuple(r) for r in call(grads, by=["iter"]).collect())
        apart = sorted((it, *tuple(r)) for it in range(3)
                       for r in call(grads.where(f"iter = {it}").drop("iter")).collect())
        assert together == apart, name

"""Goldens for the 8x8 fixture (values 1..64) and its two 4-worker groups.

The matrices are the state after the reference's scatter-reduce loops,
worked out by hand from its index arithmetic (FIXTURES.md section 2).
"""

import numpy as np
import pytest

from vecreduce import operators as op
from vecreduce.sources import counting_matrix, matrix_literal, matrix_rows

# Expected matrices (row = worker, column = element).
F1_SCATTER = [
    [1, 240, 237, 224, 201, 168, 125, 72],
    [10, 10, 248, 236, 214, 182, 140, 88],
    [27, 28, 19, 256, 235, 204, 163, 112],
    [52, 54, 46, 28, 264, 234, 194, 144],
    [85, 88, 81, 64, 37, 272, 233, 184],
    [126, 130, 124, 108, 82, 46, 280, 232],
    [175, 180, 175, 160, 135, 100, 55, 288],
    [232, 238, 234, 220, 196, 162, 118, 64],
]
F1_TOTAL = [232, 240, 248, 256, 264, 272, 280, 288]
F2_GROUP0_SCATTER = [
    [1, 56, 49, 32, 5, 72, 61, 40],
    [10, 10, 60, 44, 18, 14, 76, 56],
    [27, 28, 19, 64, 39, 36, 23, 80],
    [52, 54, 46, 28, 68, 66, 54, 32],
]
F2_GROUP1_SCATTER = [
    [33, 184, 145, 96, 37, 200, 157, 104],
    [74, 42, 188, 140, 82, 46, 204, 152],
    [123, 92, 51, 192, 135, 100, 55, 208],
    [180, 150, 110, 60, 196, 162, 118, 64],
]
F2_GROUP0_TOTAL = [52, 56, 60, 64, 68, 72, 76, 80]
F2_GROUP1_TOTAL = [180, 184, 188, 192, 196, 200, 204, 208]


def f1_rows():
    return [[8 * w + c + 1 for c in range(8)] for w in range(8)]


def as_matrix(df, value, row="worker", rows=8, cols=8, row_offset=0):
    m = np.zeros((rows, cols), dtype=np.int64)
    for r in df.collect():
        m[r[row] - row_offset][r["dim"]] = r[value]
    return m.tolist()


@pytest.fixture(scope="module")
def f1_local(spark):
    lit = matrix_literal(spark, f1_rows())
    return op.local_sums(op.to_long(lit, "vec", worker="worker", scale=1))


def test_literal_and_generated_matrix_agree(spark):
    a = sorted((r.worker, list(r.vec)) for r in matrix_literal(spark, f1_rows()).collect())
    b = sorted((r.worker, list(r.vec)) for r in counting_matrix(spark, 8, 8).collect())
    assert a == b


def test_scatter_reduce_golden(f1_local):
    out = op.scatter_reduce(f1_local, 8)
    assert as_matrix(out, "partial") == F1_SCATTER


def test_all_reduce_and_all_gather_golden(f1_local):
    totals = {r.dim: r.total for r in op.all_reduce(f1_local).collect()}
    assert [totals[c] for c in range(8)] == F1_TOTAL
    gathered = as_matrix(op.all_gather(f1_local, 8), "total")
    assert gathered == [F1_TOTAL] * 8


def test_group_scatter_reduce_golden(f1_local):
    out = op.scatter_reduce(f1_local, 8, group_size=4)
    g0 = as_matrix(out.where("grp = 0"), "partial", rows=4)
    g1 = as_matrix(out.where("grp = 1"), "partial", rows=4, row_offset=4)
    assert g0 == F2_GROUP0_SCATTER
    assert g1 == F2_GROUP1_SCATTER


def test_group_totals_and_merge_golden(f1_local):
    gt = {(r.grp, r.dim): r.grp_total for r in op.group_all_reduce(f1_local, 4).collect()}
    assert [gt[(0, c)] for c in range(8)] == F2_GROUP0_TOTAL
    assert [gt[(1, c)] for c in range(8)] == F2_GROUP1_TOTAL
    gathered = op.group_all_gather(f1_local, 4, 8)
    m = as_matrix(gathered, "grp_total")
    assert m[:4] == [F2_GROUP0_TOTAL] * 4 and m[4:] == [F2_GROUP1_TOTAL] * 4
    for method in ("window", "rollup"):
        h = op.hierarchical_all_reduce(f1_local, 4, method=method).collect()
        assert len(h) == 16
        assert all(r.total == F1_TOTAL[r.dim] for r in h)


def test_scatter_reduce_wide_vectors_two_stripes(spark):
    """Vector length 2n: each worker handles two stripes per step (dim mod n addressing)."""
    rows = [[8 * w + c + 1 for c in range(8)] for w in range(4)]
    local = op.local_sums(op.to_long(matrix_literal(spark, rows), "vec", worker="worker", scale=1))
    assert as_matrix(op.scatter_reduce(local, 4), "partial", rows=4) == F2_GROUP0_SCATTER


def test_matrix_sink(f1_local):
    rows = matrix_rows(f1_local).orderBy("worker").collect()
    assert [r.line for r in rows] == [", ".join(map(str, r)) for r in f1_rows()]


def test_cross_group_merge_golden(f1_local):
    out = op.cross_group_merge(f1_local, 4, 8)
    assert as_matrix(out, "total") == [F1_TOTAL] * 8
    assert all(r.grp == r.worker // 4 for r in out.collect())

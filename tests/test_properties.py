"""Properties on seeded integer matrices."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecreduce import operators as op
from vecreduce.sources import matrix_literal


def seeded(seed, workers, dims, lo=-50, hi=50):
    return np.random.default_rng(seed).integers(lo, hi, size=(workers, dims))


def local_of(spark, mat, partitions=None):
    df = matrix_literal(spark, mat.tolist())
    if partitions:
        df = df.repartition(partitions)
    return op.local_sums(op.to_long(df, "vec", worker="worker", scale=1))


def by_cell(df, value):
    return {(r.worker, r.dim): r[value] for r in df.collect()}


@pytest.mark.parametrize("seed,workers,dims", [(1, 8, 8), (2, 8, 13), (3, 5, 7), (4, 4, 16)])
def test_total_is_column_sum_and_ring_invariants(spark, seed, workers, dims):
    m = seeded(seed, workers, dims)
    local = local_of(spark, m)
    totals = {r.dim: r.total for r in op.all_reduce(local).collect()}
    assert [totals[c] for c in range(dims)] == m.sum(axis=0).tolist()
    sr = op.scatter_reduce(local, workers).collect()
    for r in sr:
        if r.ring_pos == 0:
            assert r.partial == m[r.worker][r.dim]
        if r.ring_pos == workers - 1:
            assert r.partial == totals[r.dim]
        owner_ring = [(r.dim + s) % workers for s in range(r.ring_pos + 1)]
        assert r.partial == sum(m[w][r.dim] for w in owner_ring)
    gathered = by_cell(op.all_gather(local, workers), "total")
    assert all(v == totals[d] for (_, d), v in gathered.items())


@pytest.mark.parametrize("groups", [1, 2, 4, 8])
def test_hierarchical_equals_flat(spark, groups):
    m = seeded(7, 8, 10)
    local = local_of(spark, m)
    flat = {r.dim: r.total for r in op.all_reduce(local).collect()}
    for method in ("window", "rollup"):
        h = op.hierarchical_all_reduce(local, 8 // groups, method=method).collect()
        assert len(h) == groups * 10
        assert all(r.total == flat[r.dim] for r in h)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_invariant_under_partitioning_and_order(spark, parts):
    m = seeded(11, 8, 9)
    base = by_cell(op.scatter_reduce(local_of(spark, m), 8), "partial")
    again = by_cell(op.scatter_reduce(local_of(spark, m, partitions=parts), 8), "partial")
    assert base == again
    shuffled = matrix_literal(spark, m.tolist()).orderBy("vec")
    again2 = by_cell(op.scatter_reduce(
        op.local_sums(op.to_long(shuffled, "vec", worker="worker", scale=1)), 8), "partial")
    assert base == again2


def test_linear_in_input(spark):
    a, b = seeded(21, 8, 6), seeded(22, 8, 6)
    ta = {r.dim: r.total for r in op.all_reduce(local_of(spark, a)).collect()}
    tb = {r.dim: r.total for r in op.all_reduce(local_of(spark, b)).collect()}
    tab = {r.dim: r.total for r in op.all_reduce(local_of(spark, 3 * a + b)).collect()}
    assert all(tab[d] == 3 * ta[d] + tb[d] for d in range(6))


def test_scatter_reduce_guards(spark):
    m = seeded(9, 8, 4)
    with pytest.raises(ValueError):
        op.scatter_reduce(local_of(spark, m), 8, group_size=3)
    for call in (op.scatter_reduce, op.all_gather):  # workers 4..7 are not in a ring of 4
        with pytest.raises(Exception, match="outside the ring"):
            call(local_of(spark, m), 4).collect()


def test_single_worker_is_identity(spark):
    m = seeded(5, 1, 6)
    local = local_of(spark, m)
    sr = op.scatter_reduce(local, 1).collect()
    assert sorted((r.dim, r.partial) for r in sr) == list(enumerate(m[0].tolist()))


def test_worker_with_many_rows_and_missing_worker(spark):
    """A worker may own any number of rows; one without rows just contributes nothing."""
    rows = [(0, [1.0, 2.0]), (0, [3.0, 4.0]), (2, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "worker int, vec array<double>")
    local = op.local_sums(op.to_long(df, "vec", worker="worker", scale=1))
    assert sorted((r.worker, r.dim, r.g) for r in local.collect()) == [
        (0, 0, 4), (0, 1, 6), (2, 0, 5), (2, 1, 6)]
    totals = {r.dim: r.total for r in op.all_reduce(local).collect()}
    assert totals == {0: 9, 1: 12}


def test_fixed_point_is_order_free(spark):
    """Doubles whose float sum depends on order still give one exact total."""
    vals = [1e-7, 0.1, 0.2, 0.3, 1e6, -1e6, 0.7]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(vals)], "worker int, vec array<double>")
    totals = set()
    for parts in (1, 3, 7):
        long = op.to_long(df.repartition(parts), "vec", worker="worker")
        totals.add(op.all_reduce(long).first().total)
    assert totals == {sum(int(np.floor(v * 1e6 + 0.5)) for v in vals)}


def test_invalid_elements(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")])], "worker int, vec array<double>")
    with pytest.raises(Exception):
        op.all_reduce(op.to_long(df, "vec", worker="worker")).collect()
    z = op.all_reduce(op.to_long(df, "vec", worker="worker", on_invalid="zero")).collect()
    assert sorted((r.dim, r.total) for r in z) == [(0, 1_000_000), (1, 0)]
    bad = spark.createDataFrame([(0, [1.0, float("nan"), float("inf")]), (1, [2.0, 3.0, None])],
                                "worker int, vec array<double>")
    sk = op.all_reduce(op.to_long(bad, "vec", worker="worker", on_invalid="skip")).collect()
    assert sorted((r.dim, r.total) for r in sk) == [(0, 3_000_000), (1, 3_000_000), (2, None)]
    with pytest.raises(ValueError):
        op.to_long(df, "vec", worker="worker", on_invalid="keep")
    keyless = spark.createDataFrame([(None, [1.0]), (3, [2.0])], "vec_id long, vec array<double>")
    # the key check fires wherever the worker is used (a plain all-reduce does not use it)
    with pytest.raises(Exception, match="null worker key"):
        op.local_sums(op.to_long(keyless, "vec", "vec_id", 8)).collect()
    with pytest.raises(Exception, match="null worker key"):
        op.scatter_reduce(op.to_long(keyless, "vec", "vec_id", 8), 8).collect()
    assert op.all_reduce(op.to_long(keyless, "vec", "vec_id", 8, on_invalid="skip")).first().total == 2_000_000
    nulls = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "worker int, vec array<double>")
    with pytest.raises(Exception, match="null vector"):
        op.all_reduce(op.to_long(nulls, "vec", worker="worker")).collect()
    skipped = op.all_reduce(op.to_long(nulls, "vec", worker="worker", on_invalid="zero")).collect()
    assert sorted((r.dim, r.total) for r in skipped) == [(0, 1_000_000), (1, 2_000_000)]


def test_keyed_sum_default_and_set(spark):
    ev = spark.createDataFrame(
        [(1, 10, 5, 2.0), (2, 10, 6, 3.0), (3, 11, 6, 7.0), (4, 11, 6, 1.0)],
        "event_id long, user_id long, ts long, value double")
    totals = op.keyed_sum(ev, "user_id", "value")
    keys = spark.range(9, 13).withColumnRenamed("id", "user_id")
    got = {r.user_id: r.total for r in op.with_default(keys, totals, "user_id").collect()}
    assert got == {9: 0, 10: 5.0, 11: 8.0, 12: 0}
    last = {r.user_id: r.value for r in op.keyed_set(ev, "user_id", "value", ["ts", "event_id"]).collect()}
    assert last == {10: 3.0, 11: 1.0}


def test_assemble_dense_check(spark):
    cells = spark.createDataFrame([(0, 0, 5), (0, 2, 7), (1, 0, 1), (1, 1, 2)], "worker int, dim int, g long")
    loose = {r.worker: r.vec for r in op.assemble(cells, keys=["worker"]).collect()}
    assert loose == {0: [5, 7], 1: [1, 2]}  # positions follow sorted dims
    with pytest.raises(Exception, match="not 0..k-1"):
        op.assemble(cells, keys=["worker"], dense=True).collect()
    ok = op.assemble(cells.where("worker = 1"), keys=["worker"], dense=True).first().vec
    assert ok == [1, 2]
    with pytest.raises(ValueError, match="keys"):
        op.assemble(cells, keys=[])


def test_wide_totals_beyond_bigint(spark):
    """Totals past BIGINT: the default raises (ANSI), wide=True is exact."""
    big = spark.range(0, 4096, 1, 4).selectExpr("cast(id % 8 as int) worker",
                                               "array(cast(4.0e12 as double), 1.5) vec")
    long = op.to_long(big, "vec", worker="worker")  # 4e18 units per cell, 4096 cells per dim
    with pytest.raises(Exception):
        op.all_reduce(long).collect()
    got = {r.dim: r.total for r in op.all_reduce(long, wide=True).collect()}
    assert got == {0: float(4096 * 4 * 10 ** 18), 1: float(4096 * 1_500_000)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), rows=st.integers(1, 30), dims=st.integers(1, 9),
       spread=st.sampled_from([1e-6, 0.5, 1.0, 1e3]))
def test_fixed_point_totals_equal_numpy(spark, seed, rows, dims, spread):
    """Spark's fixed-point totals equal numpy's floor(x * 1e6 + 0.5) sums, bit for bit."""
    rng = np.random.default_rng(seed)
    m = rng.normal(0.0, spread, size=(rows, dims))
    m[rng.random(size=m.shape) < 0.1] = 0.5e-6  # exact half-unit cases
    df = spark.createDataFrame([(i % 4, [float(x) for x in r]) for i, r in enumerate(m)],
                               "worker int, vec array<double>").repartition(3)
    got = {r.dim: r.total for r in op.all_reduce(op.to_long(df, "vec", worker="worker")).collect()}
    want = np.floor(m * 1e6 + 0.5).astype(np.int64).sum(axis=0)
    assert [got[d] for d in range(dims)] == want.tolist()


def test_empty_input_everywhere(spark):
    """No rows in: empty results (or one row of null sums and a zero count), no errors."""
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    cells = op.to_long(empty, "embedding", "vec_id", 8)
    for df in (op.all_reduce(cells), op.local_sums(cells), op.scatter_reduce(cells, 8),
               op.all_gather(cells, 8), op.group_all_gather(cells, 4, 8), op.cross_group_merge(cells, 4, 8),
               op.gradient_stats(empty.withColumn("loss", F.lit(1.0)), "embedding", "loss"),
               op.hierarchical_all_reduce(cells, 4), op.map_partitions_sum(empty),
               op.vector_stats(cells), op.assemble(cells, keys=["worker"])):
        assert df.count() == 0
    stats = op.tree_stats(cells, {"grad": "g"}, "g").first()
    assert (stats.grad, stats.loss, stats.cnt) == (None, None, 0)


def test_missing_workers_and_short_vectors_still_get_every_total(spark):
    """Workers 0, 2, 3 of a ring of 4, worker 2 one element long: 12 cells, worker 1 included."""
    rows = [(0, [1.0, 2.0, 3.0]), (2, [10.0]), (3, [100.0, 200.0, 300.0])]
    cells = op.to_long(spark.createDataFrame(rows, "worker int, vec array<double>"), "vec", worker="worker", scale=1)
    m = np.array([[1, 2, 3], [0, 0, 0], [10, 0, 0], [100, 200, 300]])
    gathered = by_cell(op.all_gather(cells, 4), "total")
    assert gathered == {(w, d): int(m[:, d].sum()) for w in range(4) for d in range(3)}
    assert by_cell(op.cross_group_merge(cells, 2, 4), "total") == gathered
    groups = by_cell(op.group_all_gather(cells, 2, 4), "grp_total")
    assert groups == {(w, d): int(m[w // 2 * 2:w // 2 * 2 + 2, d].sum()) for w in range(4) for d in range(3)}
    partial = by_cell(op.scatter_reduce(cells, 4), "partial")
    assert partial == {(w, d): int(sum(m[(d + s) % 4, d] for s in range((w - d) % 4 + 1)))
                       for w in range(4) for d in range(3)}


def test_gradient_stats_triple(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.5), ([3.0], 0.25), ([], 1.0)], "v array<double>, loss double")
    got = sorted(map(tuple, op.gradient_stats(df.repartition(2), "v", "loss", scale=1).collect()))
    assert got == [(0, 4, 1.75, 3), (1, 2, 1.75, 3)]
    bad = spark.createDataFrame([(None, 1.0)], "v array<double>, loss double")
    with pytest.raises(Exception, match="null vector"):
        op.gradient_stats(bad, "v", "loss").collect()
    assert op.gradient_stats(bad.unionByName(df), "v", "loss", on_invalid="zero").first().cnt == 4

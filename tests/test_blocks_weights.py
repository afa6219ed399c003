"""Blocked vectors, weight tables and least squares on sums of products."""

import random

import numpy as np
import pytest

from vecreduce import operators as op
from vecreduce.plans import inspect
from vecreduce.session import scratch_path
from test_session_settings import settings


def table(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")


def ragged(seed, many=60, longest=23):
    rng = random.Random(seed)
    return [[rng.randint(-5_000, 5_000) / 1000 for _ in range(rng.randint(0, longest))] for _ in range(many)]


def fixed(x):
    return int(np.floor(x * 1e6 + 0.5))


@pytest.mark.parametrize("levels", [(), (3,), (5, 2)])
@pytest.mark.parametrize("width", [1, 4, 64])
def test_block_sum_equals_brute_force(spark, width, levels):
    vectors = ragged(width)
    blocks = op.to_blocks(table(spark, vectors).repartition(6), width=width)
    assert all(len(r["values"]) <= width for r in blocks.collect())
    totals = op.block_all_reduce(blocks, width=width, levels=levels)
    assert max(len(r.total) for r in totals.collect()) <= width
    want = {}
    for v in vectors:
        for d, x in enumerate(v):
            want[d] = want.get(d, 0) + fixed(x)
    assert {r.dim: r.total for r in op.blocks_to_dims(totals, width=width).collect()} == want


def test_shuffle_is_a_row_a_block(spark):
    blocks = op.to_blocks(table(spark, [[1.0] * 640] * 40).repartition(4), width=64)
    totals = op.block_all_reduce(blocks)
    assert inspect.count_exchanges(totals) == 2  # the repartition and one by block
    tree = inspect.physical_section(inspect.plan_text(totals))
    assert "PythonMapInArrow" not in tree and totals.count() == 10


def test_block_sums_fail_beyond_bigint_in_any_session(spark):
    big = spark.createDataFrame([(0, [5 * 10 ** 18, 1])] * 2, "block int, values array<bigint>")
    for ansi in ("true", "false"):
        with settings(spark, **{"spark.sql.ansi.enabled": ansi}):
            with pytest.raises(Exception, match="exceeds BIGINT"):
                op.block_all_reduce(big).collect()
            with pytest.raises(Exception, match="more than 1 elements"):
                op.block_all_reduce(big, width=1).collect()


def test_invalid_elements_and_vectors(spark):
    rows = table(spark, [[1.0, None], [float("nan"), 2.0], None, []])
    with pytest.raises(Exception, match="null"):
        op.to_blocks(rows).collect()
    got = op.block_all_reduce(op.to_blocks(rows, on_invalid="zero")).collect()
    assert [r.total for r in got] == [[1_000_000, 2_000_000]]
    assert op.block_all_reduce(op.to_blocks(table(spark, []))).count() == 0


@pytest.mark.parametrize("levels", [(), (3,)])
def test_triple_counts_every_row(spark, levels):
    vectors = ragged(9)
    rows = spark.createDataFrame([(v, i / 4) for i, v in enumerate(vectors)], "v array<double>, loss double").repartition(5)
    got = op.block_stats(rows, "v", "loss", width=8, levels=levels)
    assert not inspect.has_any(got, inspect.PAIRWISE)
    got = got.collect()
    assert {(r.loss, r.cnt) for r in got} == {(sum(i / 4 for i in range(60)), 60)}
    assert sum(len(r.grad) for r in got) == max(map(len, vectors))


def test_dims_to_blocks_is_the_inverse_and_checks_places(spark):
    cells = spark.createDataFrame([(d, d * 0.5) for d in range(37)], "dim int, w double")
    blocks = op.dims_to_blocks(cells.repartition(5), "w", width=8)
    back = op.blocks_to_dims(blocks, "w", width=8)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    for bad in ([(0, 1.0), (2, 1.0)], [(0, 1.0), (0, 2.0)]):
        with pytest.raises(Exception, match="gap or a repeated"):
            op.dims_to_blocks(spark.createDataFrame(bad, "dim int, w double"), "w", width=8).collect()


def test_weight_versions(spark):
    weights = op.WeightTable(spark, width=4)
    weights.write_dims(0, spark.createDataFrame([(d, float(d)) for d in range(6)], "dim int, w double"))
    totals = spark.createDataFrame([(0, [1_000_000] * 4), (1, [2_000_000] * 2)], "block int, total array<bigint>")
    last = op.descend(weights, lambda version, w: totals, 0.5, 2, 3)
    want = {d: d - 3 * 0.5 * (1 if d < 4 else 2) / 2 for d in range(6)}
    assert {r.dim: r.w for r in op.blocks_to_dims(last, "w", width=4).collect()} == pytest.approx(want)
    assert weights.history().groupBy("version").count().count() == 4
    with pytest.raises(Exception, match="exist"):
        weights.write(1, last)
    short = spark.createDataFrame([(0, [1_000_000] * 4), (1, [2_000_000])], "block int, total array<bigint>")
    for other in (short, totals.where("block = 0")):
        with pytest.raises(Exception, match="different elements"):
            op.updated(weights.read(0), other, 0.5, 2).collect()


def test_a_million_weights_make_a_plan_of_the_same_size(spark):
    def plan(n):
        weights = op.WeightTable(spark)
        ids = spark.range(n).selectExpr("cast(id as int) dim", "cast(id as double) w")
        weights.write_dims(0, ids)
        totals = op.dims_to_blocks(ids.selectExpr("dim", "cast(w as long) total"), "total")
        step = op.updated(weights.read(0), totals, 0.1, 8)
        assert step.agg({"block": "count"}).first()[0] == -(-n // 64)
        return inspect.physical_section(inspect.plan_text(step))

    small, large = plan(128), plan(1_000_000)
    assert len(small.splitlines()) == len(large.splitlines())


def gram_of(x, y, scale):
    z = [[fixed_at(v, scale) for v in row] + [fixed_at(t, scale * scale)] for row, t in zip(x, y)]
    return {(i, j): sum(r[i] * r[j] for r in z) for i in range(len(z[0])) for j in range(len(z[0]))}


def fixed_at(x, scale):
    return int(np.floor(x * float(scale) + 0.5))


@pytest.mark.parametrize("size", [1.0, 4e5, 3e10])
def test_gram_equals_whole_numbers(spark, size):
    rng = random.Random(int(size))
    x = [[rng.uniform(-size, size) for _ in range(5)] for _ in range(70)]
    y = [rng.uniform(-size, size) for _ in x]
    scale = 10_000 if size < 1e9 else 100
    df = spark.createDataFrame(list(zip(x, y)), "v array<double>, y double").repartition(3)
    got = {(r.i, r.j): int(r.g) for r in op.gram(df, "v", "y", scale).collect()}
    assert got.pop((-1, -1)) == 70 and got == gram_of(x, y, scale)


def test_fit_equals_iterations_over_rows(spark):
    rng = random.Random(3)
    x = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(50)]
    y = [rng.randint(0, 3) for _ in x]
    df = spark.createDataFrame(list(zip(x, y)), "v array<double>, y int").repartition(4)
    scale, lr, w, want = 1000, 0.3, [0] * 4, []
    rows = [([fixed_at(v, scale) for v in r], fixed_at(t, scale * scale)) for r, t in zip(x, y)]
    for it in range(1, 12):
        slope = [sum(r[k] * (sum(a * b for a, b in zip(r, w)) - t) for r, t in rows) for k in range(4)]
        w = [int(np.floor(float(a) - lr * (float(g) / (50.0 * scale * scale)) + 0.5)) for a, g in zip(w, slope)]
        want += [(it, k, v / scale) for k, v in enumerate(w)]
    for cut in (3, 8, 100):
        got = op.descend_on_gram(df, "v", "y", lr, 11, scale, cut_every=cut)
        assert sorted(map(tuple, got.collect())) == want


def test_fit_reads_the_data_once(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0)] * 9, "v array<double>, y double")
    path = scratch_path(spark, "t-fit")
    df.write.parquet(path)
    plan = inspect.plan_text(op.ls_fit(spark.read.parquet(path), "v", "y", 0.1, 5))
    assert path.split("/")[-1] not in plan  # only the stored sums are read by the iterations


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_fit_fails_rather_than_wraps(spark, ansi):
    df = spark.createDataFrame([([4e9, 1.0], 1.0), ([-4e9, 2.0], 2.0)], "v array<double>, y double")
    with settings(spark, **{"spark.sql.ansi.enabled": ansi}), pytest.raises(Exception, match="out of range|beyond"):
        op.ls_fit(df, "v", "y", 20.0, 3).collect()

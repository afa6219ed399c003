"""Column helpers: fixed point and exact sums; sinks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from vecreduce import operators as op
from vecreduce.functions import exact_sum, exact_sum_over, from_fixed, product_sum, to_fixed, wide_sum
from vecreduce.session import scratch_path
from vecreduce.sources import counting_matrix, to_local, write_parquet


def test_fixed_point_round_half_up(spark):
    df = spark.createDataFrame([(0.0000005,), (-0.0000005,), (1.2345675,), (2.5,)], "x double")
    got = [r.g for r in df.select(to_fixed("x").alias("g")).collect()]
    assert got == [1, 0, 1234568, 2500000]
    back = spark.range(1).select(from_fixed(F.lit(1234568), 1_000_000).alias("v")).first().v
    assert back == 1.234568


def test_fixed_point_range_guard_in_any_session(spark):
    df = spark.createDataFrame([(1e13,)], "x double")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(Exception, match="fixed-point range"):
                df.select(to_fixed("x").alias("g")).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    assert df.select(to_fixed("x", 1).alias("g")).first().g == 10 ** 13
    nulls = spark.createDataFrame([(None,)], "x double")
    assert nulls.select(to_fixed("x").alias("g")).first().g is None


def test_ml_vector_input(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(0, Vectors.dense([1.0, 2.0])), (1, Vectors.sparse(2, [1], [5.0]))],
                               ["worker", "features"])
    tot = {r.dim: r.total for r in op.all_reduce(
        op.to_long(df, "features", worker="worker", scale=1)).collect()}
    assert tot == {0: 1, 1: 7}


def test_write_parquet_and_bounded_collect(spark):
    path = scratch_path(spark, "t-parquet")
    local = op.local_sums(op.to_long(counting_matrix(spark, 4, 4), "vec", worker="worker", scale=1))
    write_parquet(local, path, partition_by=["worker"])
    assert len(glob.glob(os.path.join(path, "worker=*"))) == 4
    assert spark.read.parquet(path).count() == 16
    assert len(list(to_local(spark.read.parquet(path)))) == 16


def test_wide_sum_exact_for_signed_and_large_values(spark):
    vals = [2 ** 62 - 1, 2 ** 62 - 7, -(2 ** 62), 12345678901234, -1, 0, -(2 ** 41) - 3, 3 * 2 ** 42 + 5]
    df = spark.createDataFrame([(v,) for v in vals], "v long").repartition(3)
    got = df.agg(wide_sum("v").alias("s")).first().s
    assert got == float(sum(vals))
    # a sum far beyond BIGINT: 2^20 rows of 2^62 - 1
    big = spark.range(1 << 20).select(F.lit(2 ** 62 - 1).cast("long").alias("v"))
    assert big.agg(wide_sum("v").alias("s")).first().s == float((2 ** 62 - 1) * (1 << 20))
    nulls = spark.createDataFrame([(None,)], "v long")
    assert nulls.agg(wide_sum("v").alias("s")).first().s is None


@pytest.fixture(params=["true", "false"], ids=["ansi", "no-ansi"])
def ansi(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.ansi.enabled")


def test_sums_and_squares_are_exact_or_fail_in_any_session(spark, ansi):
    df = spark.createDataFrame([(0, [4000.0, 6e12]), (1, [-4000.0, 6e12])], "vec_id long, embedding array<double>")
    cells = op.to_long(df.select("vec_id", F.slice("embedding", 1, 1).alias("embedding")), "embedding", "vec_id", 8)
    got = op.vector_stats(cells).first()
    assert (got.total, got.sq, got.cnt) == (0, 3.2e19, 2)
    both = op.to_long(df, "embedding", "vec_id", 8)
    for total in (op.all_reduce(both), op.all_gather(both, 8), op.scatter_reduce(both, 8),
                  op.hierarchical_all_reduce(both, 4), op.map_partitions_sum(df)):
        with pytest.raises(Exception, match="exceeds BIGINT"):
            total.collect()
    assert {r.dim: r.total for r in op.all_reduce(both, wide=True).collect()} == {0: 0.0, 1: 1.2e19}
    one = spark.createDataFrame([(4_000_000_000, 1, 0)], "x long, w long, y long")
    row = op.ls_gradient(one, ["x"], "y", [1], exact=True).first()
    assert row.g0 == row.sse == 1.6e19
    with pytest.raises(Exception, match="beyond BIGINT"):
        op.ls_gradient(one, ["x"], "y", [1 << 40], exact=True).collect()


def test_exact_sums_of_nulls_and_windows(spark, ansi):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "k int, v long")
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("v").alias("s")).collect()}
    assert got == {1: 5, 2: None}
    w = Window.partitionBy("k")
    assert sorted(r.s or 0 for r in df.select(exact_sum_over("v", w).alias("s")).collect()) == [0, 5, 5]
    big = spark.createDataFrame([(2 ** 62,), (2 ** 62,), (-7,)], "v long")
    assert big.agg(product_sum("v", "v").alias("s")).first().s == 2 * 2 ** 124 + 49
    with pytest.raises(Exception, match="exceeds BIGINT"):
        big.agg(exact_sum("v")).collect()


def test_sparse_vectors_give_their_stored_cells(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(0, Vectors.sparse(5_000_000, [4_999_999], [2.0])), (1, Vectors.sparse(3, [], [])),
                                (2, Vectors.dense([])), (3, Vectors.dense([1.0, 3.0]))], ["worker", "features"])
    cells = op.to_long(df, "features", worker="worker", scale=1)
    assert sorted(map(tuple, cells.collect())) == [(0, 4_999_999, 2), (3, 0, 1), (3, 1, 3)]


def test_matrix_rows_of_ragged_workers(spark, capsys):
    from vecreduce.sources import matrix_rows, show_matrix

    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0, 5.0, 6.0]), (0, [10.0, 10.0])]
    for order in (rows, rows[::-1]):
        cells = op.to_long(spark.createDataFrame(order, "worker int, vec array<double>"), "vec", worker="worker", scale=1)
        assert sorted(map(tuple, matrix_rows(cells).collect())) == [(0, 2, "11, 12"), (1, 4, "3, 4, 5, 6")]
    show_matrix(cells)
    assert "3, 4, 5, 6" in capsys.readouterr().out

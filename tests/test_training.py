"""Gradient descent: bounds from the reference's gradient shape, least squares vs numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from vecreduce import operators as op
from vecreduce.sources import embeddings, synthetic_gradients


def test_synthetic_gradients_shape_and_determinism(spark):
    g = synthetic_gradients(spark, iterations=3, seed=7)
    rows = g.collect()
    assert len(rows) == 3 * 8 * 10
    assert all(10 * r.worker <= r.g < 10 * r.worker + 15 for r in rows)
    again = synthetic_gradients(spark, iterations=3, seed=7).repartition(5).collect()
    assert sorted(rows) == sorted(again)


def test_gd_trajectory_bounds(spark):
    """Mean of 8 gradients 10i + U{0..14} lies in [35, 49]: each step drops w by 7.0 to 9.8."""
    grads = synthetic_gradients(spark, iterations=5, seed=3)
    traj = op.gd_trajectory(grads, lr=0.2, n=8, scale=1, w0=1.0).collect()
    w = {(r.iter, r.dim): r.w for r in traj}
    assert len(w) == 5 * 10
    for d in range(10):
        prev = 1.0
        for it in range(5):
            drop = prev - w[(it, d)]
            assert 7.0 - 1e-9 <= drop <= 9.8 + 1e-9
            prev = w[(it, d)]


def test_gd_trajectory_matches_iterated_update(spark):
    grads = synthetic_gradients(spark, iterations=4, workers=8, dims=3, seed=9)
    pdf = grads.toPandas()
    traj = {(r.iter, r.dim): r.w for r in op.gd_trajectory(grads, 0.2, 8, 1).collect()}
    w = np.ones(3)
    for it in range(4):
        g = pdf[pdf.iter == it].groupby("dim").g.sum().sort_index().to_numpy()
        w = w - 0.2 * g / 8
        assert np.allclose([traj[(it, d)] for d in range(3)], w, rtol=0, atol=1e-12)


def test_least_squares_gradient_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-5, 6, size=(200, 3))
    y = rng.integers(-20, 21, size=200)
    df = spark.createDataFrame([(*map(int, r), int(t)) for r, t in zip(x, y)],
                               "a long, b long, c long, y long").repartition(4)
    w = [1, -2, 3]
    row = op.ls_gradient(df, ["a", "b", "c"], "y", w, exact=True).first()
    err = x @ np.array(w) - y
    assert [row.g0, row.g1, row.g2] == [float(v) for v in (x * err[:, None]).sum(axis=0)]
    assert row.sse == float((err ** 2).sum()) and row.cnt == 200
    fractional = df.withColumn("a", F.col("a") + 0.5)
    with pytest.raises(ValueError, match="integral"):
        op.ls_gradient(fractional, ["a", "b", "c"], "y", w, exact=True)


def test_tree_stats_true_sum(spark):
    df = spark.range(0, 5, 1, 5).select(F.lit(2).cast("long").alias("g"), F.lit(3).alias("l"))
    row = op.tree_stats(df, {"grad": "g"}, "l").first()
    assert (row.grad, row.loss, row.cnt) == (10, 15.0, 5)


def test_tree_stats_fractional_loss_golden(spark):
    """Five rows, loss 0.2 and count 1 each: loss 1.0, count 5 (fixture F5)."""
    df = spark.range(0, 5, 1, 5).select(F.lit(0.2).alias("l"))
    exact = op.tree_stats(df, {}, "l", loss_scale=1_000_000).first()
    assert (exact.loss, exact.cnt) == (1.0, 5)
    plain = op.tree_stats(df, {}, "l").first()
    assert abs(plain.loss - 1.0) < 1e-12 and plain.cnt == 5


def test_gd_step(spark):
    totals = spark.createDataFrame([(0, 8_000_000), (1, -4_000_000), (2, 0)], "dim int, total long")
    got = {r.dim: r.w for r in op.gd_step(totals, lr=0.5, n=4).collect()}
    assert got == {0: 1.0 - 0.5 * 8.0 / 4, 1: 1.0 + 0.5 * 4.0 / 4, 2: 1.0}
    w0 = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, -1.0)], "dim int, w double")
    got = {r.dim: r.w for r in op.gd_step(totals, lr=0.5, n=4, w0=w0).collect()}
    assert got == {0: 1.0, 1: 0.5, 2: -1.0}


def test_gd_step_fails_on_different_lengths(spark):
    totals = spark.createDataFrame([(d, 10_000_000 * (d + 1)) for d in range(10)], "dim int, total long")
    w0 = spark.createDataFrame([(d, 1.0) for d in range(8)], "dim int, w double")
    for t, w in ((totals, w0), (totals.where("dim < 5"), w0)):
        with pytest.raises(Exception, match="different elements"):
            op.gd_step(t, 0.2, 8, w0=w).collect()
    # ten-element gradients and eight weights: the caller says which eight
    out = op.gd_step(totals.where("dim < 8"), lr=0.2, n=8, w0=w0).orderBy("dim").collect()
    assert [r.w for r in out] == [1.0 - 0.2 * (10.0 * (d + 1)) / 8 for d in range(8)]


def test_least_squares_fit_matches_numpy_and_converges(spark):
    emb = embeddings(spark, SF01, ("embedding",))
    y = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * 2)
    got = {(r.iter, r.dim): r.w for r in op.ls_fit(emb, "embedding", y, lr=20.0, iterations=5).collect()}
    again = {(r.iter, r.dim): r.w for r in op.ls_fit(emb.repartition(7), "embedding", y, 20.0, 5).collect()}
    assert again == got and len(got) == 5 * 64
    X = np.array([r.embedding for r in emb.collect()], dtype=np.float64)
    Y, w, far = 2 * X.sum(axis=1), np.zeros(64), []
    for it in range(1, 6):
        w = w - 20.0 * (X * (X @ w - Y)[:, None]).sum(axis=0) / len(Y)
        mine = np.array([got[(it, d)] for d in range(64)])
        assert np.allclose(mine, w, atol=2e-3)
        far.append(np.linalg.norm(mine - 2))
    assert far == sorted(far, reverse=True)


def test_least_squares_fit_defined_cases(spark):
    none = spark.createDataFrame([], "v array<double>, y double")
    assert op.ls_fit(none, "v", "y", 1.0, 3).count() == 0
    for rows in ([([1.0], 1.0), ([1.0, 2.0], 1.0)], [([1.0], None)], [(None, 1.0)], [([None], 1.0)]):
        with pytest.raises(Exception):
            op.ls_fit(spark.createDataFrame(rows, "v array<double>, y double"), "v", "y", 1.0, 1)


def test_least_squares_gradient_of_nulls(spark):
    df = spark.createDataFrame([(1, 2), (None, 5), (3, None)], "x long, y long")
    with pytest.raises(Exception, match="null feature"):
        op.ls_gradient(df, ["x"], "y", [1], exact=True).collect()
    row = op.ls_gradient(df, ["x"], "y", [1], exact=True, on_invalid="skip").first()
    assert (row.g0, row.sse, row.cnt) == (-1.0, 1.0, 1)


def test_event_cells_of_invalid_events(spark):
    import datetime

    t = datetime.datetime(1970, 1, 3)
    rows = [(t, 1, "a", 2.0), (t, 9, "a", None), (t, 1, "a", float("nan")), (None, 1, "a", 5.0), (t, None, "a", 7.0)]
    ev = spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double")
    for bad in (rows[1], rows[2], rows[3], rows[4]):
        with pytest.raises(Exception, match="vecreduce"):
            op.event_gradients(spark.createDataFrame([bad], ev.schema)).collect()
    assert op.event_cells(ev, on_invalid="skip").where("g is not null").count() == 1
    got = {tuple(r) for r in op.event_gradients(ev, on_invalid="zero").collect()}
    assert got == {(2, 1, "a", 200)}

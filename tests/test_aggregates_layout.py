"""User-defined aggregates, layout-keeping functions, exact splits, stored tables, file sources and the network."""

import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from vecreduce import operators as op
from vecreduce import sources as src
from vecreduce.plans import inspect
from vecreduce.plans.catalogue import BY_NAME
from vecreduce.session import scratch_path
from vecreduce.sources import datasource


def values(seed, many=2000, large=10 ** 6):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, 40 + i % 50]), rng.randint(-large, large)) for i in range(many)]


@pytest.mark.parametrize("levels,most", [((16,), 200_000), ((), 5), ((3, 2), 1)])
def test_moments_are_exact(spark, levels, most):
    rows = values(1)
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = op.aggregate_by_key(df, "k", ["v"], op.Moments(), levels, most).collect()
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    assert {r.k: tuple(r)[1:] for r in got} == {
        k: (len(v), *[Decimal(sum(x ** p for x in v)) for p in range(1, 5)]) for k, v in by.items()}


def test_largest_values_merge_in_any_order(spark):
    rows = [(k % 3, v % 50) for k, v in values(2)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(9)
    got = op.aggregate_by_key(df, "k", ["v"], op.Largest(4), (5,), 2).collect()
    for r in got:
        counts = Counter(v for k, v in rows if k == r.k)
        best = sorted(counts, reverse=True)[:4]
        assert r.largest == best and r.times == [counts[v] for v in best]
    assert len(got) == 3


def test_two_inputs_text_keys_and_invalid_rows(spark):
    class Weighted(op.Aggregate):
        """A state of two inputs: the value of the largest weight, the lowest of equal ones."""

        returns = "best double"

        def zero(self):
            return None

        def add(self, state, value, weight):
            at = int(np.lexsort((value, -weight))[0])
            return self.merge(state, (float(weight[at]), float(value[at])))

        def merge(self, state, other):
            known = [s for s in (state, other) if s is not None]
            return min(known, key=lambda s: (-s[0], s[1]))

        def value(self, state):
            return (state[1],)

    rows = [("a", 1.0, 3.0), ("a", 2.0, 5.0), ("b", 7.0, 1.0), ("a", 0.5, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(3)
    got = op.aggregate_by_key(df, "k", ["v", "w"], Weighted())
    assert sorted(map(tuple, got.collect())) == [("a", 0.5), ("b", 7.0)]
    assert op.aggregate_by_key(df.limit(0), "k", ["v", "w"], Weighted()).count() == 0
    for bad in [(None, 1.0, 1.0), ("a", None, 1.0)]:
        with pytest.raises(Exception, match="null key or value"):
            op.aggregate_by_key(spark.createDataFrame([bad], df.schema), "k", ["v", "w"], Weighted()).collect()


def test_states_shuffled_are_at_most_tasks_times_keys(spark):
    from pyspark.sql.types import StructType
    from vecreduce.operators.aggregate import _folded

    df = spark.createDataFrame([(k % 4, v) for k, v in values(3)], "key long, v0 long").repartition(6)
    schema = StructType.fromDDL("key long, salt int, state binary")
    states = df.mapInArrow(_folded(op.Moments(), 100, schema), schema)
    assert states.count() <= 6 * 4


def _final_tree(df):
    df.collect()
    text = inspect.plan_text(df, mode="simple")
    return text.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]


def test_function_sum_and_join_share_one_exchange(spark):
    df = BY_NAME["partition_function"].build(spark, SF001)
    tree = _final_tree(df)
    made = [line for line in tree.splitlines() if "Exchange" in line and "Reused" not in line and "Broadcast" not in line]
    assert len(made) == 1, tree


def test_bucketed_table_needs_no_exchange(spark):
    rows = spark.range(300).selectExpr("id", "cast(id % 5 as int) worker", "array(cast(id as double), 1.0) v")
    stored = op.write_bucketed(rows, "t_bucketed_workers", ["worker"], 4, scratch_path(spark, "t-bucketed"))
    try:
        scored = stored.withColumn("score", op.position_weighted_column("v", 1)).drop("v")
        found = op.with_totals(scored, ["worker"], {"total": lambda w: F.sum("score").over(w)})
        sums = scored.groupBy("worker").agg(F.sum("score").alias("again"))
        found = found.join(sums.hint("shuffle_hash"), "worker")
        assert inspect.count_exchanges(found) == 0, inspect.plan_text(found)
        want = defaultdict(int)
        for i in range(300):
            want[i % 5] += i + 2
        assert all(r.score == r.id + 2 and r.total == r.again == want[r.worker] for r in found.collect())
        assert found.count() == 300
    finally:
        spark.sql("drop table t_bucketed_workers")


def test_expression_and_function_agree(spark):
    rows = spark.createDataFrame([(v,) for v in ([], [1.5], [-0.25, 3.0, 2.5])], "v array<double>")
    both = op.with_function(rows, op.position_weighted(100), ["v"], "long", "p").withColumn(
        "e", op.position_weighted_column("v", 100))
    assert sorted((r.p, r.e) for r in both.collect()) == [(0, 0), (150, 150), (1325, 1325)]
    for bad in ([None], None):
        row = spark.createDataFrame([(bad,)], "v array<double>")
        with pytest.raises(Exception, match="null"):
            row.select(op.position_weighted_column("v", 100)).collect()
        with pytest.raises(Exception, match="null"):
            op.with_function(row, op.position_weighted(100), ["v"], "long", "p").collect()


def test_function_of_several_inputs(spark):
    def scaled(batches):
        import pyarrow.compute as pc
        for a, b in batches:
            yield pc.multiply(a, b)

    df = op.with_function(spark.range(50).selectExpr("id", "id + 1 as k"), scaled, ["id", "k"], "long", "p")
    assert all(r.p == r.id * r.k for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 7, 500])
@pytest.mark.parametrize("weights", [{"a": 0.8, "b": 0.2}, {"a": 1, "b": 1, "c": 2}, {"a": 0, "b": 1}, {"a": 1}])
def test_exact_split_has_exact_counts(spark, n, weights):
    df = spark.range(n).withColumnRenamed("id", "k")
    counts = Counter(r.split for r in op.exact_split(df, "k", weights).collect())
    total, share, bounds = float(sum(weights.values())), 0.0, []
    for w in list(weights.values())[:-1]:
        share += w
        bounds.append(int(share / total * n + 0.5))
    ends = [*bounds, n]
    want = {k: b - a for k, a, b in zip(weights, [0, *ends[:-1]], ends)}
    assert counts == {k: v for k, v in want.items() if v}


def test_exact_split_does_not_depend_on_partitions_and_keeps_keys_together(spark):
    keys = [f"k{i % 90}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    found = [{r.k: r.split for r in op.exact_split(df.repartition(p), "k", {"x": 2, "y": 1}).collect()} for p in (1, 9)]
    assert found[0] == found[1] and Counter(found[0].values()) == {"x": 60, "y": 30}
    with pytest.raises(Exception, match="null key"):
        op.exact_split(spark.createDataFrame([(None,)], "k string"), "k", {"x": 1, "y": 1}).collect()
    with pytest.raises(ValueError):
        op.exact_split(df, "k", {"x": -1, "y": 2})


def test_equal_hashes_go_by_key(spark, monkeypatch):
    from vecreduce.operators import ml
    monkeypatch.setattr(ml, "_hash60", lambda key: (key.cast("long") % 3).cast("long"))
    found = {r.id: r.split for r in ml.exact_split(spark.range(30), "id", {"x": 0.5, "y": 0.5}).collect()}
    order = sorted(range(30), key=lambda i: (i % 3, i))
    assert [found[i] for i in order] == ["x"] * 15 + ["y"] * 15


def test_stored_table_is_reused_verified_and_released(spark):
    path = scratch_path(spark, "t-stored")
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("id", "cast(id as string) s").mapInArrow(count, "id long, s string")
    first = op.materialise(df, path)
    assert (first.reused, first.count, calls.value) == (False, 100, 100)
    again = op.materialise(df, path)
    assert (again.reused, again.count, again.digest) == (True, 100, first.digest)
    again.verify()
    spark.catalog.clearCache()  # whatever executors held is gone
    assert again.df.agg(F.sum("id")).first()[0] == 4950 and calls.value == 100
    with pytest.raises(ValueError, match="another schema"):
        op.materialise(spark.range(3), path)
    spark.range(5).selectExpr("id", "'x' as s").write.mode("append").parquet(f"{path}/data")
    with pytest.raises(RuntimeError, match="105 rows"):
        op.materialise(df, path).verify()
    again.release()
    assert not op.materialise(df, path).reused


def test_a_table_without_manifest_is_written_anew(spark):
    path = scratch_path(spark, "t-torn")
    spark.range(7).write.parquet(f"{path}/data")  # as a run that was lost left it
    found = op.materialise(spark.range(3), path)
    assert (found.reused, found.count) == (False, 3)
    empty = op.materialise(spark.range(0), scratch_path(spark, "t-none"))
    assert (empty.count, empty.digest) == (0, "0")


LINES = b"1 1:0.5 3:-2\n\n0 2:1e3 \r\n2\n3 1:0.25 2:0.5 3:0.75"


@pytest.mark.parametrize("split", [1, 2, 3, 5, 9, 16, 1000])
def test_byte_ranges_cut_inside_lines(spark, tmp_path, split):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.txt").write_bytes(LINES)
    (folder / "b.txt").write_bytes(LINES + b"\n")
    (folder / "_SUCCESS").write_bytes(b"not a line")
    want = [(1.0, [0, 2], [0.5, -2.0]), (0.0, [1], [1000.0]), (2.0, [], []), (3.0, [0, 1, 2], [0.25, 0.5, 0.75])] * 2
    for path in (str(folder), f"file://{folder}"):
        got = src.load_files(spark, src.LibSVMSource, path, split)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    ranges = [(a, min(a + split, len(LINES))) for a in range(0, len(LINES), split)]
    found = [x for a, b in ranges for x in datasource.lines_of(str(folder / "a.txt"), a, b)]
    assert b"\n".join(line for _, line in found) == LINES
    assert all(LINES[at:].startswith(line) for at, line in found)


def test_wrong_lines_fail_with_file_and_offset(spark, tmp_path):
    for text, source in ((b"1 1:2\n1 2:3 1:4\n", src.LibSVMSource), (b"1 1:2\n1 x:3\n", src.LibSVMSource),
                         (b"1,2,3\n4,?,6\n", src.DenseSource)):
        file = tmp_path / "bad.txt"
        file.write_bytes(text)
        with pytest.raises(Exception, match="bad.txt at byte 6"):
            src.load_files(spark, source, str(file)).collect()
    with pytest.raises(Exception, match="no such path"):
        src.load_files(spark, src.DenseSource, str(tmp_path / "none")).collect()
    (tmp_path / "empty").mkdir()
    assert src.load_files(spark, src.DenseSource, str(tmp_path / "empty")).count() == 0


def test_sparse_vectors_are_never_dense(spark, tmp_path):
    file = tmp_path / "wide.txt"
    file.write_text("1 1:0.5 900000000:2\n0 7:1 900000000:-1\n2\n")
    vectors = src.read_libsvm(spark, str(file), 1_000_000_000)
    got = sorted(map(tuple, op.sparse_all_reduce(vectors).collect()))
    assert got == [(0, 500_000, 1), (6, 1_000_000, 1), (899_999_999, 1_000_000, 2)]


@pytest.mark.parametrize("n", [1, 8, 10_000])
def test_scatter_reduce_is_linear_in_workers(spark, n):
    rng = random.Random(n)
    cells = [(rng.randrange(n), d, rng.randint(-9, 9)) for d in (0, 1, 5) for _ in range(40)]
    df = spark.createDataFrame(cells, "worker int, dim int, g long")
    got = {(r.worker, r.dim): r.partial for r in op.scatter_reduce(df, n).collect()}
    assert len(got) == 3 * n
    for d in (0, 1, 5):
        own = Counter()
        for w, dim, g in cells:
            if dim == d:
                own[w] += g
        run = 0
        for pos in range(n):
            w = (d + pos) % n
            run += own[w]
            assert got[w, d] == run
    assert "try_element_at" not in inspect.plan_text(op.scatter_reduce(df, n))


@pytest.fixture(scope="module")
def network(spark):
    rows = [(i, [math.sin(i * (j + 1)) for j in range(6)], float(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label double")
    data = op.vector_features(df, "v")
    return df, data, op.mlp_fit(data, (6, 5, 4, 3), max_iter=15)


def forward(x, layers, weights):
    """All layers' outputs, with numpy; the last by softmax."""
    outs, at = [x], 0
    for k, (inputs, units) in enumerate(zip(layers, layers[1:])):
        w = weights[at:at + inputs * units].reshape(inputs, units)
        z = outs[-1] @ w + weights[at + inputs * units:at + (inputs + 1) * units]
        at += (inputs + 1) * units
        outs.append(1 / (1 + np.exp(-z)) if k < len(layers) - 2 else np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))
    return outs


def test_forward_pass_equals_the_model_and_numpy(spark, network):
    df, data, model = network
    weights = model.weights.toArray()
    table = op.mlp_weights(spark, (6, 5, 4, 3), weights)
    assert table.count() == len(weights)
    ours = {r.vec_id: r.prediction for r in op.mlp_forward(df, table, "v").collect()}
    assert ours == {r.vec_id: r.prediction for r in model.transform(data).collect()}
    x = np.array([r.v for r in df.orderBy("vec_id").collect()])
    by_hand = forward(x, (6, 5, 4, 3), weights)[-1].argmax(axis=1)
    assert [ours[i] for i in range(150)] == by_hand.tolist()
    with pytest.raises(Exception, match="not 6 inputs"):
        op.mlp_forward(spark.createDataFrame([([1.0],)], "v array<double>"), table, "v").collect()
    with pytest.raises(ValueError):
        op.mlp_weights(spark, (6, 5, 4, 3), weights[:-1])


def test_longer_fits_lower_the_loss_and_its_numpy_gradient(spark, network):
    """The fit minimises the mean cross entropy: by numpy's own gradient it ends near a stationary point."""
    df, data, _ = network
    rows = df.orderBy("vec_id").collect()
    x, y = np.array([r.v for r in rows]), np.eye(3)[[int(r.label) for r in rows]]
    layers = (6, 4, 3)

    def loss_and_gradient(weights):
        outs = forward(x, layers, weights)
        delta, parts = (outs[-1] - y) / len(x), []
        loss = -np.log((outs[-1] * y).sum(axis=1)).mean()
        ends = np.cumsum([(a + 1) * b for a, b in zip(layers, layers[1:])])
        for k in reversed(range(len(layers) - 1)):
            parts.insert(0, np.concatenate([(outs[k].T @ delta).ravel(), delta.sum(axis=0)]))
            start = ends[k] - (layers[k] + 1) * layers[k + 1]
            w = weights[start:start + layers[k] * layers[k + 1]].reshape(layers[k], layers[k + 1])
            delta = (delta @ w.T) * outs[k] * (1 - outs[k])
        return loss, np.concatenate(parts)

    found = [loss_and_gradient(op.mlp_fit(data, layers, max_iter=n).weights.toArray()) for n in (1, 20, 400)]
    assert found[0][0] > found[1][0] > found[2][0]
    assert np.abs(found[2][1]).max() < 0.01 < np.abs(found[0][1]).max() + 0.01
    w = np.linspace(-1, 1, 6 * 4 + 4 + 4 * 3 + 3)  # the numpy gradient itself, against differences
    loss, gradient = loss_and_gradient(w)
    for at in (0, 13, 27, 30, 42):
        step = np.zeros_like(w)
        step[at] = 1e-6
        numeric = (loss_and_gradient(w + step)[0] - loss_and_gradient(w - step)[0]) / 2e-6
        assert gradient[at] == pytest.approx(numeric, abs=1e-6)

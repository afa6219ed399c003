import random
import re

import helpers as h
import numpy as np
import pytest
from pyspark.sql import functions as F
from vecreduce.llm import mixing as op

WEIGHTS = [5, 2, 1]


def wanted(sizes, share=1.5, most=2.0):
    """Targets by sharing the rest again until no source is above its bound."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    done, total = {}, share * sum(sizes.values())
    while len(done) < len(names):
        open_ = [s for s in names if s not in done]
        level = (total - sum(done.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not over:
            return done | {s: weight[s] * level for s in open_}
        done |= {s: most * sizes[s] for s in over}
    return done


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        source = f"s{i % 7}" if i % 3 else "hot"
        n = int(rng.lognormvariate(3.5, 1.2))
        rows.append((i, " ".join(["w"] * n), source))
    rows += [(1000 + i, "a few words", None) for i in range(40)] + [(2000, "", "empty"), (2001, None, "empty")]
    return h.docs(spark, rows).repartition(5), rows


def test_targets_and_taken(spark, corpus):
    df, rows = corpus
    got = op.mixed(df).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len((next(t for i, t, _ in rows if i == r.id) or "").split())
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        s = source[r.id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    assert all(r.source_size == sizes[source[r.id]] for r in got)
    want = wanted(sizes)
    assert target == pytest.approx(want)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 15)
    assert sorted(map(tuple, op.mixed(df.repartition(3)).collect())) == sorted(map(tuple, got))


def test_the_tilts_solve_the_dual(spark, corpus):
    df, _ = corpus
    sizes = df.select("source", op.size_of(df.text).alias("size"))
    counts = sizes.where("size > 0").groupBy("source", "size").count().withColumnRenamed("count", "documents")
    targets = op.targets(sizes)
    found = op.tilts(counts, targets, op.BySource(targets)).collect()
    groups = {}
    for s, size, n in h.rows(counts):
        groups.setdefault(s, []).append((size, n))
    for r in found:
        x, n = np.array(groups[r.source], dtype=float).T
        with np.errstate(over="ignore"):
            rate = np.minimum(2, np.exp(r.tilt * x / r["mean"]))
        assert (n * x * rate).sum() == pytest.approx(r.target, rel=1e-5)
    assert {r.source for r in found} == {s for s in groups}


def test_copies_are_the_rows_of_the_mix(spark, corpus):
    df, _ = corpus
    df = h.with_clashing_columns(df)
    rows = op.copied(df)
    assert rows.columns == df.columns + ["copy"]
    times = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert times == {r.id: r.copies for r in op.mixed(df).collect() if r.copies}


def test_size_counts_words_between_ascii_white_space(spark):
    texts = ["a b\tc\x0bd\x0ce\rf\ng", " ", "", None, "a\u00a0b é😀 \u2003", "\x1fx"]
    df = h.docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r.n for r in df.select("doc_id", op.size_of(df.text).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_odd_rows_and_empty_tables(spark):
    df = h.odd(spark)
    got = op.mixed(h.with_clashing_columns(df)).collect()
    assert len(got) == df.count() and all(r.taken <= 2 * r["size"] for r in got)
    assert op.mixed(h.docs(spark, [])).count() == 0
    assert op.copied(h.docs(spark, [])).count() == 0
    assert [r.taken for r in op.mixed(h.docs(spark, [(1, ""), (2, None)])).collect()] == [0, 0]
    assert op.copied(df).where("doc_id is null").count() <= 4


def test_a_column_named_copy_stays(spark):
    df = h.docs(spark, [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)])
    given = op.copied(df)
    clash = op.copied(df.selectExpr("*", "'mine' as Copy", "1 as copy_"))
    assert clash.columns[-3:] == ["Copy", "copy_", "copy__"]
    assert sorted((r.doc_id, r["copy__"]) for r in clash.collect()) == sorted((r.doc_id, r["copy"]) for r in given.collect())
    assert {r["Copy"] for r in clash.collect()} == {"mine"}


@pytest.mark.parametrize("words", [400, 1])
def test_equal_documents_miss_the_target_by_one_at_most(spark, words):
    rows = [(i + 1000 * s, "w " * words, f"s{s}") for s in range(4) for i in range(50)]
    for start in (0, 7_000_000):
        got = op.mixed(h.docs(spark, [(i + start, t, s) for i, t, s in rows]).withColumnRenamed("source", "src"),
                       source_col="src").join(
            h.docs(spark, [(i + start, t, s) for i, t, s in rows]).select(F.col("doc_id").alias("id"), "source"), "id")
        for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r.taken - r.target) <= words


def test_mixed_sizes_come_nearer_than_the_longest_document(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([1, 3, 20, 90, 300]), f"s{i % 5}") for i in range(400)]
    got = op.mixed(h.docs(spark, rows)).join(h.docs(spark, rows).select(F.col("doc_id").alias("id"), "source"), "id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 150
    assert {r.copies for r in got.select("copies").distinct().collect()} <= {0, 1, 2}


def test_more_sources_than_are_broadcast(spark, corpus, monkeypatch):
    df, _ = corpus
    many = df.withColumn("source", F.when(F.col("source") == "s1", F.concat(F.lit("t"), F.col("doc_id") % 60))
                         .otherwise(F.col("source"))).withColumn("salt", F.lit("x"))
    odd = many.unionByName(many.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    sizes = odd.select(F.col("doc_id").alias("id"), "source", op.size_of(F.col("text")).alias("size"))
    plan, by_source = op._plan(op.saved(sizes, "test-sizes"), op.WEIGHTS, op.SHARE, op.MOST)
    want = sorted(map(tuple, op._with_copies(sizes, plan, by_source, op.MOST).collect()), key=str)
    monkeypatch.setattr(op, "MOST_SOURCES", 2)
    by_source = op.BySource(plan)
    assert not by_source.small and len(want) == odd.count()
    assert sorted(map(tuple, op._with_copies(sizes, plan, by_source, op.MOST).collect()), key=str) == want
    monkeypatch.setattr(op, "SALTS", 3)
    rows = odd.select(F.col("doc_id").alias("id"), "source", F.length("text").alias("size"))
    table = op.targets(rows).where("source <> 's2'")
    for how in ("inner", "left"):
        got = op.BySource(table)(rows, table, how)
        plan = got._jdf.queryExecution().toString()
        assert got.columns == ["id", "source", "size", "source_size", "target"] and "salt" in plan
        small = rows.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), how).drop("s")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)

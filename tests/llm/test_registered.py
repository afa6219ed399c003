"""Every registered corpus query against its SQL, and the pipeline stage by stage."""

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest
from vecreduce.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"mixing"}
    assert [f"{f.__name__}" for _, f in corpus_pipeline.STAGES] == [
        "language_stage", "exact_dedup_stage", "simhash_stage", "decontamination_stage", "mixing_stage"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(
        map(str, want.select(", ".join(columns)).fetchall()))


def test_query_returns_a_row_for_every_input_row(spark):
    for name in ("op2_mix_sources", "op6_token_counts"):
        assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    schema = docs.schema
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, SF), "test-stage")
        if stage is not corpus_pipeline.mixing_stage:
            assert docs.schema == schema
        if stage is corpus_pipeline.exact_dedup_stage:
            texts = [r.text.lower() for r in docs.collect()]
            assert len(texts) == len(set(texts)) == len({r.text.lower() for r in before.collect()})
        if stage is corpus_pipeline.decontamination_stage:
            left = corpus_pipeline.decontaminate.matched(docs, benchmark)
            assert left.where("n_hit > 0").count() == 0
            assert corpus_pipeline.decontaminate.matched(before, benchmark).where("n_hit > 0").count() > 0
            assert all(r.text == given[r.doc_id] or r.n_chars == len(r.text) for r in docs.collect())
    copies = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(given)

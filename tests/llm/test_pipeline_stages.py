"""Every pipeline stage on odd rows, an empty table and columns with clashing names."""

import corpus_pipeline
import helpers as h
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_empty_and_clashing_tables(spark, name, stage):
    df = h.odd(spark)
    texts = {r.text for r in df.collect()}
    last = stage is corpus_pipeline.mixing_stage
    for given in (h.with_clashing_columns(df), df):
        found = stage(spark, given, SF)
        assert found.columns[:len(given.columns)] == given.columns and len(found.columns) == len(given.columns) + last
        rows = found.collect()
        assert {r.text for r in rows} <= texts
    assert stage(spark, h.docs(spark, []), SF).count() == 0

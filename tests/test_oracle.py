"""Every catalogue query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from conftest import SF01
from vecreduce.plans.catalogue import CATALOGUE
from vecreduce.plans.verify import compare

WITH_SQL = [q for q in CATALOGUE if q.sql is not None]
ROWS_ONLY = [q for q in CATALOGUE if q.sql is None]


@pytest.mark.parametrize("q", WITH_SQL, ids=[q.name for q in WITH_SQL])
def test_query_matches_oracle(spark, duck01, q):
    out = compare(q.name, q.build(spark, SF01), q.sql, duck01)
    assert out.ok, out.detail
    assert out.rows > 0


@pytest.mark.parametrize("q", ROWS_ONLY, ids=[q.name for q in ROWS_ONLY])
def test_rows_only_queries_run(spark, q):
    assert q.build(spark, SF01).count() > 0


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert [f.name for f in df.schema.fields] == ["dim", "total"]
    assert df.count() == 64
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_readme_counts_match_catalogue():
    import os
    import re

    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                               "README.md")).read()
    m = re.search(r"There are (\d+) registered queries: (\d+) with oracle SQL", readme)
    assert m and int(m.group(1)) == len(CATALOGUE) and int(m.group(2)) == len(WITH_SQL)
    ids = {f"O{i:02d}" for i in range(1, 38)}
    covered = {o for q in CATALOGUE for o in q.operators}
    assert covered <= ids
    for oid in ids:  # every inventory operator has a row in the README table
        assert f"| {oid} |" in readme, oid

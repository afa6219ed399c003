"""Keyed operators vs pandas on random small inputs (ties in the order broken by a unique id)."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vecreduce import operators as op

rows = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(-50, 50)),
                min_size=1, max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 4))
def test_keyed_sum_set_default_match_pandas(spark, data, parts):
    recs = [(i, user, ts, val) for i, (user, ts, val) in enumerate(data)]
    pdf = pd.DataFrame(recs, columns=["event_id", "user_id", "ts", "value"])
    df = spark.createDataFrame(recs, "event_id long, user_id long, ts long, value long").repartition(parts)

    sums = {r.user_id: r.total for r in op.keyed_sum(df, "user_id", "value").collect()}
    assert sums == pdf.groupby("user_id").value.sum().to_dict()

    last = {r.user_id: r.value for r in op.keyed_set(df, "user_id", "value", ["ts", "event_id"]).collect()}
    want = pdf.sort_values(["ts", "event_id"]).groupby("user_id").value.last().to_dict()
    assert last == want

    keys = spark.range(-1, 8).withColumnRenamed("id", "user_id")
    filled = {r.user_id: r.total for r in op.with_default(keys, op.keyed_sum(df, "user_id", "value"),
                                                          "user_id").collect()}
    assert filled == {k: sums.get(k, 0) for k in range(-1, 8)}

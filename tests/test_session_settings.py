"""Results do not depend on session settings: broadcast threshold, ANSI mode, time zone."""

import contextlib

import pytest

from conftest import SF01
from vecreduce.plans import inspect
from vecreduce.plans.catalogue import BY_NAME

QUERIES = ["keyed_sum_default", "gd_trajectory", "event_gradients", "scatter_reduce",
           "hierarchical_all_reduce", "least_squares_gradient", "keyed_set", "hash_split"]


@contextlib.contextmanager
def settings(spark, **conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def rows(spark, name):
    return sorted(tuple(r) for r in BY_NAME[name].build(spark, SF01).collect())


@pytest.fixture(scope="module")
def baseline(spark):
    return {q: rows(spark, q) for q in QUERIES}


def test_without_broadcast_the_join_sort_merges(spark, baseline):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, **off):
        df = BY_NAME["keyed_sum_default"].build(spark, SF01)
        got = sorted(tuple(r) for r in df.collect())
        plan = inspect.plan_text(df)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert got == baseline["keyed_sum_default"]


@pytest.mark.parametrize("conf", [{"spark.sql.ansi.enabled": "false"},
                                  {"spark.sql.session.timeZone": "America/Los_Angeles"},
                                  {"spark.sql.session.timeZone": "Asia/Kolkata"},
                                  {"spark.sql.adaptive.enabled": "false"},
                                  {"spark.sql.shuffle.partitions": "200"},
                                  {"spark.sql.shuffle.partitions": "1",
                                   "spark.sql.adaptive.enabled": "false"}],
                         ids=["ansi-off", "tz-la", "tz-kolkata", "aqe-off", "partitions-200",
                              "partitions-1"])
def test_same_results_under_settings(spark, baseline, conf):
    with settings(spark, **conf):
        for q in QUERIES:
            assert rows(spark, q) == baseline[q], q

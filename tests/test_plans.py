"""Plan shape: what a 100x larger input would make expensive is kept out of the plans."""

import pytest

from conftest import SF01
from vecreduce.plans import inspect
from vecreduce.plans.catalogue import BY_NAME, CATALOGUE

PYTHON_ALLOWED = {"map_partitions_sum", "moments", "largest_values", "partition_function", "least_squares_fit"}
# Static plan exchange budget for the headline queries.
EXCHANGES = {
    "all_reduce_sum": 1, "keyed_sum": 1, "tree_stats": 1, "least_squares_gradient": 1,
    "vector_stats": 1, "gradient_stats": 2, "keyed_set": 1, "event_gradients": 1,
    "scatter_reduce": 2, "group_scatter_reduce": 2, "all_gather": 1, "cross_group_merge": 1,
    "group_all_gather": 2, "hierarchical_all_reduce": 2, "gd_trajectory": 2, "matrix_pivot": 2,
    "map_partitions_sum": 1, "partition_function": 1, "block_all_reduce": 2, "block_stats": 4, "sparse_all_reduce": 1,
    "gd_step_given": 4,
}
PLANNED = [q for q in CATALOGUE if q.name not in {"least_squares_fit", "mlp_fit_predict", "mlp_accuracy", "cache_count"}]


@pytest.fixture(scope="module")
def built(spark):
    return {q.name: q.build(spark, SF01) for q in PLANNED}


@pytest.mark.parametrize("name", [q.name for q in PLANNED])
def test_no_pairwise_join_and_no_row_python(built, name):
    df = built[name]
    assert not inspect.has_any(df, inspect.PAIRWISE)
    assert not inspect.has_any(df, inspect.ROW_PYTHON)
    if name not in PYTHON_ALLOWED:
        assert not inspect.has_any(df, inspect.ARROW_PYTHON)


@pytest.mark.parametrize("name,budget", sorted(EXCHANGES.items()))
def test_exchange_budget(built, name, budget):
    assert inspect.count_exchanges(built[name]) <= budget


def test_summary(built):
    s = inspect.summary(built["keyed_sum_default"])
    assert s["pairwise_joins"] == [] and s["row_python"] == [] and s["exchanges"] >= 1
    assert any("EqualTo(event_type,purchase)" in f for f in s["pushed_filters"])


def test_scans_are_pruned(built):
    for name in ("all_reduce_sum", "gd_step", "dense_text_source"):
        assert all(s == "struct<embedding:array<float>>" for s in inspect.read_schemas(built[name]))
    for s in inspect.read_schemas(built["least_squares_gradient"]):
        assert "l_orderkey" not in s and "l_shipdate" not in s and "l_returnflag" not in s


def test_filter_reaches_the_scan(built):
    pushed = " ".join(inspect.pushed_filters(built["keyed_sum_default"]))
    assert "EqualTo(event_type,purchase)" in pushed


def test_partial_aggregation_before_exchange(built):
    tree = inspect.physical_section(inspect.plan_text(built["all_reduce_sum"]))
    lines = tree.splitlines()
    ex = next(i for i, ln in enumerate(lines) if "Exchange" in ln)
    assert any("HashAggregate" in ln for ln in lines[ex + 1:]), tree
    details = inspect.plan_text(built["all_reduce_sum"])
    assert "partial_try_sum" in details


def test_flagship_is_one_codegen_stage_to_the_shuffle(spark):
    import re

    df = BY_NAME["all_reduce_sum"].build(spark, SF01)
    df.collect()  # AQE reports codegen stages in the final plan
    text = inspect.plan_text(df, mode="simple")
    final = text.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    stage = lambda pat: re.search(r"\*\((\d+)\) " + pat, final)
    gen, part = stage("Generate posexplode"), stage(r"HashAggregate\(keys=\[dim#\d+\], functions=\[partial_try_sum")
    # scan -> filter -> generate -> project -> partial aggregate: one codegen stage
    assert gen and part and gen.group(1) == part.group(1), final


CODEGEN_MAP_SIDE = ["all_reduce_sum", "scatter_reduce", "keyed_sum", "least_squares_gradient",
                    "gd_trajectory", "tree_stats", "vector_stats", "dense_text_source",
                    "hierarchical_all_reduce", "event_gradients"]


@pytest.mark.parametrize("name", CODEGEN_MAP_SIDE)
def test_map_side_runs_in_codegen(spark, name):
    """Every operator between the scan and the first shuffle is inside whole-stage codegen."""
    df = BY_NAME[name].build(spark, SF01)
    df.collect()  # final adaptive plan
    text = inspect.plan_text(df, mode="simple")
    final = text.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
    lines = [ln for ln in final.splitlines() if ln.strip()]
    below = lines[max(i for i, ln in enumerate(lines) if "Exchange" in ln) + 1:]
    ops = [ln.split("+- ")[-1].strip() for ln in below]
    ops = [op for op in ops if op and not op.startswith(("FileScan", "Scan ", "BatchScan"))]
    assert ops and all(op.startswith("*(") for op in ops), "\n".join(below)

"""Command-line runner."""

from conftest import SF001
from vecreduce import cli
from vecreduce.session import scratch_path


def test_list(capsys):
    assert cli.main(["--list"]) == 0
    out = capsys.readouterr().out
    assert "all_reduce_sum" in out and "least_squares_fit" in out


def test_run_writes_parquet(spark):
    out = scratch_path(spark, "t-cli")
    assert cli.main(["all_reduce_sum", SF001, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 64


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_REPEAT="1", BENCH_QUERIES="all_reduce_sum",
               BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], capture_output=True,
                         text=True, timeout=600, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= d.keys()
    assert d["unit"] == "sec" and d["sf"] == "0.001" and set(d["queries"]) == {"all_reduce_sum"}


def test_explain_flag(spark, capsys):
    assert cli.main(["keyed_sum", SF001, "--explain"]) == 0
    out = capsys.readouterr().out
    assert "Physical Plan" in out and "exchanges: 1" in out and "pairwise_joins: []" in out


def test_module_entry_point():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=root)
    out = subprocess.run([sys.executable, "-m", "vecreduce", "--list"], capture_output=True,
                         text=True, timeout=300, env=env, cwd="/")
    assert out.returncode == 0, out.stderr[-2000:]
    assert len([ln for ln in out.stdout.splitlines() if ln.strip()]) == len(cli.CATALOGUE)

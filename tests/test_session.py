"""Scratch folders come from spark.checkpoint.dir and nowhere else."""

import pytest

from vecreduce.session import scratch_path


def test_scratch_under_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert a.startswith(root.rstrip("/") + "/t-") and a != b


def test_the_setting_is_required():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Session, "t")

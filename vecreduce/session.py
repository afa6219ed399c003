"""Session and scratch-folder helpers.

Library functions never build their own session: they take the caller's
``SparkSession``.  ``local_session`` exists for tests, the bench and the
examples; on a cluster the application's own session is used unchanged.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_OF_LOCAL: dict[str, str] = {}  # folders of local sessions without the setting, by application


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "vecreduce", extra: dict | None = None) -> SparkSession:
    """A ``local[cpus]`` session tuned for small-data tests and the bench.

    AQE stays on (runtime coalescing, skew-join splitting, broadcast
    conversion behind ``autoBroadcastJoinThreshold``); the UI is off.
    """
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new, unique folder name under the shared folder in ``spark.checkpoint.dir``.

    On a cluster the setting is required: a folder of the driver's own is not visible to
    executors.  A ``local`` session, whose tasks run in the driver, gets one if it has none.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root and re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", None) or ""):
        app = spark.conf.get("spark.app.id")
        if app not in _OF_LOCAL:
            _OF_LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="vecreduce-")
        root = _OF_LOCAL[app]
    if not root:
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set; point it at a folder every executor can reach")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

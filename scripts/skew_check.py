"""Skew check: one key / one worker holding a third of all rows.

    python scripts/skew_check.py [sf_dir]

Derives skewed inputs from the driver tables (every third event re-keyed to
user 0, every third vector assigned to worker 0), runs the keyed and
all-reduce operators, and reads Spark's event log (written to a fresh scratch
folder) to report, per shuffle, how many records the busiest reduce task read
against the mean.  With map-side partial aggregation the hot key arrives as
one partial row per map task, so the busiest task stays close to the mean.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from vecreduce import operators as op  # noqa: E402
from vecreduce import sources as src  # noqa: E402
from vecreduce.functions import CENTS, to_fixed  # noqa: E402
from vecreduce.session import local_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="vecreduce-eventlog-")
    spark = local_session(8, extra={"spark.eventLog.enabled": "true",
                                    "spark.eventLog.dir": log_dir,
                                    "spark.eventLog.compress": "false",
                                    "spark.sql.adaptive.enabled": "false"})
    ev = src.events(spark, sf_dir, ["event_id", "ts", "user_id", "value"]).repartition(16)
    hot_ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0))
                           .otherwise(F.col("user_id")))
    emb = src.embeddings(spark, sf_dir).repartition(16)
    hot_emb = emb.withColumn("worker", F.when(F.col("vec_id") % 3 == 0, F.lit(0))
                             .otherwise(F.pmod("vec_id", F.lit(8))).cast("int"))
    cents = hot_ev.select("user_id", to_fixed("value", CENTS).alias("c"))
    jobs = {
        "keyed_sum": lambda: op.keyed_sum(cents, "user_id", "c"),
        "keyed_set": lambda: op.keyed_set(hot_ev, "user_id", "value", ["ts", "event_id"]),
        "scatter_reduce": lambda: op.scatter_reduce(
            op.to_long(hot_emb, "embedding", worker="worker"), 8),
        "hierarchical": lambda: op.hierarchical_all_reduce(
            op.to_long(hot_emb, "embedding", worker="worker"), 4),
    }
    sc = spark.sparkContext
    hot_rows = hot_ev.where("user_id = 0").count()
    total_rows = hot_ev.count()
    for name, build in jobs.items():
        sc.setJobGroup(name, name)
        build().write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()

    stage_group, reads = {}, defaultdict(list)
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
             if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus")]
    for path in sorted(paths):
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    grp = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = grp
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    rd = m.get("Shuffle Read Metrics") or {}
                    recs = rd.get("Total Records Read", 0)
                    if recs:
                        reads[e["Stage ID"]].append(recs)
    print(f"hot user holds {hot_rows} of {total_rows} events ({hot_rows / total_rows:.0%})")
    print(f"{'query':16s} {'stage':>5s} {'tasks':>5s} {'max read':>9s} {'mean read':>10s}  role")
    seen = set()
    for sid in sorted(reads):
        grp = stage_group.get(sid)
        if grp not in jobs:
            continue
        # the first shuffle of each query is this script's repartition(16) of the input
        role = "input spread (script)" if grp not in seen else "operator shuffle"
        seen.add(grp)
        r = reads[sid]
        print(f"{grp:16s} {sid:5d} {len(r):5d} {max(r):9d} {sum(r) / len(r):10.1f}  {role}")


if __name__ == "__main__":
    main(sys.argv)

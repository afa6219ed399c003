"""Per-stage profile of one catalogue query from Spark's event log.

    python scripts/profile_query.py <query> [sf_dir] [runs]

Runs the query (build + full execution into the ``noop`` sink) ``runs``
times with the event log written to a fresh scratch folder, then reports,
for the last run, each stage's task count, wall time, input and shuffle
volumes.  No UI or REST endpoint is involved.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecreduce.plans.catalogue import BY_NAME  # noqa: E402
from vecreduce.session import local_session  # noqa: E402


def read_events(log_dir):
    paths = sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                   if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus"))
    for path in paths:
        with open(path) as fh:
            for line in fh:
                yield json.loads(line)


def main(argv):
    name = argv[1]
    sf_dir = argv[2] if len(argv) > 2 else "/root/testdata/sf0.1"
    runs = int(argv[3]) if len(argv) > 3 else 2
    log_dir = tempfile.mkdtemp(prefix="vecreduce-profile-")
    spark = local_session(8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                    "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    for i in range(runs):
        sc.setJobGroup(f"run{i}", name)
        BY_NAME[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    last = f"run{runs - 1}"
    stage_of_group, stages = {}, {}
    for e in read_events(log_dir):
        kind = e.get("Event")
        if kind == "SparkListenerJobStart":
            grp = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e.get("Stage IDs", []):
                stage_of_group[sid] = grp
        elif kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            sid = info["Stage ID"]
            acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
            stages[sid] = {
                "name": info.get("Stage Name", "")[:40],
                "tasks": info.get("Number of Tasks"),
                "ms": (info.get("Completion Time", 0) or 0) - (info.get("Submission Time", 0) or 0),
                "input": acc.get("internal.metrics.input.bytesRead", 0),
                "shuffle_read": acc.get("internal.metrics.shuffle.read.localBytesRead", 0),
                "shuffle_write": acc.get("internal.metrics.shuffle.write.bytesWritten", 0),
                "records_written": acc.get("internal.metrics.shuffle.write.recordsWritten", 0),
            }
    print(f"{name} at {sf_dir}, run {runs} of {runs}")
    print(f"{'stage':>5} {'tasks':>5} {'ms':>7} {'input B':>12} {'shuf read B':>12} "
          f"{'shuf write B':>12} {'shuf rows':>10}  name")
    total = 0
    for sid in sorted(s for s in stages if stage_of_group.get(s) == last):
        st = stages[sid]
        total += st["ms"]
        print(f"{sid:5d} {st['tasks']:5d} {st['ms']:7d} {int(st['input']):12d} "
              f"{int(st['shuffle_read']):12d} {int(st['shuffle_write']):12d} "
              f"{int(st['records_written']):10d}  {st['name']}")
    print(f"sum of stage wall times: {total} ms")


if __name__ == "__main__":
    main(sys.argv)

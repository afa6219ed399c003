"""Build an enlarged copy of the tables the catalogue reads, for scale runs.

    python scripts/scale_copy.py <out_dir> [base_sf_dir] [table=copies ...]
    BENCH_SF_DIR=<out_dir> BENCH_REPEAT=1 python bench.py

Each table is replicated on the executors (``explode(sequence)``), with
per-copy id offsets so keys stay unique (vectors, events, documents).  Users
are not offset, so every user's group grows with the copy count, which is
the skewed direction.  Written once; reuse the folder for later runs.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from vecreduce.session import local_session  # noqa: E402

# copies per table and the id column offset per copy
PLAN = {
    "embeddings": (250, "vec_id"),
    "events": (50, "event_id"),
    "lineitem": (20, None),
    "labels": (100, "doc_id"),
}


def main(argv):
    out = argv[1]
    base = argv[2] if len(argv) > 2 and "=" not in argv[2] else "/root/testdata/sf0.1"
    plan = dict(PLAN)
    for arg in argv[2:]:
        if "=" in arg:
            table, copies = arg.split("=")
            plan[table] = (int(copies), PLAN[table][1])
    spark = local_session(8)
    for table, (copies, key) in plan.items():
        target = f"{out}/{table}.parquet"
        if os.path.exists(target):
            continue
        df = spark.read.parquet(f"{base}/{table}.parquet")
        rep = df.select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"), "*")
        if key:
            span = df.agg(F.max(key)).first()[0] + 1
            rep = rep.withColumn(key, F.col(key) + F.col("_copy").cast("long") * F.lit(span))
        rep.drop("_copy").repartition(max(8, copies // 4)).write.parquet(target)
        print(table, spark.read.parquet(target).count(), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)

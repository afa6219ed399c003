"""Run one catalogue query as a Spark application.

    spark-submit --py-files vecreduce.zip vecreduce/cli.py all_reduce_sum /data/tables --out /data/out/totals
    python -m vecreduce.cli --list

(``vecreduce.zip`` is the ``vecreduce`` folder zipped, or ship the wheel.)

The session comes from ``spark-submit`` (master, executors, checkpoint
folder); nothing here sets cluster options.  Results are written to
``--out`` as parquet, or printed with ``--show N``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vecreduce.plans.catalogue import BY_NAME, CATALOGUE


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="vecreduce")
    ap.add_argument("query", nargs="?", help="catalogue query name")
    ap.add_argument("tables", nargs="?", help="folder holding <table>.parquet")
    ap.add_argument("--out", help="write the result here as parquet")
    ap.add_argument("--show", type=int, default=0, help="print this many result rows")
    ap.add_argument("--explain", action="store_true", help="print the formatted plan")
    ap.add_argument("--list", action="store_true", help="list the queries and exit")
    args = ap.parse_args(argv)
    if args.list or not args.query:
        for q in CATALOGUE:
            print(f"{q.name:32s} {' '.join(q.operators):24s} {'sql' if q.sql else 'rows'}")
        return 0
    if args.query not in BY_NAME or not args.tables:
        ap.error("give a known query name and the tables folder (see --list)")
    spark = SparkSession.builder.appName(f"vecreduce-{args.query}").getOrCreate()
    df = BY_NAME[args.query].build(spark, args.tables)
    if args.explain:
        from vecreduce.plans.inspect import summary

        df.explain(mode="formatted")
        for key, val in summary(df).items():
            print(f"{key}: {val}")
    if args.out:
        df.write.mode("errorifexists").parquet(args.out)
    if args.show:
        df.show(args.show, truncate=False)
    if not args.out and not args.show:
        df.write.format("noop").mode("overwrite").save()
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Run every catalogue query at one scale factor and compare with DuckDB.

    python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecreduce.plans.catalogue import CATALOGUE  # noqa: E402
from vecreduce.plans.verify import compare, duck_connection  # noqa: E402
from vecreduce.session import local_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session(8)
    con = duck_connection(sf_dir)
    bad = 0
    for q in CATALOGUE:
        if only and q.name not in only:
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.sql is None:
                n = df.count()
                print(f"{q.name:34s} rows-only  {n:8d} rows  {time.time() - t0:6.2f}s", flush=True)
                continue
            out = compare(q.name, df, q.sql, con)
        except Exception as e:  # report and continue with the next query
            bad += 1
            print(f"{q.name:34s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        bad += not out.ok
        print(f"{q.name:34s} {'ok' if out.ok else 'FAIL':4s} {out.rows:8d} rows  "
              f"{time.time() - t0:6.2f}s  {'' if out.ok else out.detail}", flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))

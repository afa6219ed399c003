"""Write PLANS.md: the final (post-AQE) physical plan of every catalogue query.

    python scripts/dump_plans.py [sf_dir] [out_file]

Each query is executed once (collected, so run it at a small scale factor),
then its plan is printed in Spark's simple mode (``*(n)`` marks the
whole-stage-codegen stage of an operator).  Long
expressions are shortened; the operator tree, exchanges, join strategies,
pushed filters and read schemas are kept.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import textwrap

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecreduce.plans.catalogue import CATALOGUE  # noqa: E402
from vecreduce.plans.inspect import count_exchanges  # noqa: E402
from vecreduce.session import local_session  # noqa: E402

KEEP = ("PushedFilters", "ReadSchema")


def shorten(line: str, width: int = 160) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r"raise_error\(USER_RAISED_EXCEPTION, .*?, NullType\)", "raise_error(..)", line)
    if "FileScan" in line:
        head = line.split(" Batched")[0]
        extras = [m.group(0) for k in KEEP for m in [re.search(k + r": (\[[^\]]*\]|struct<[^ ]*>)", line)] if m]
        return head + " " + " ".join(extras)
    return line if len(line) <= width else line[: width - 3] + "..."


def final_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    text = buf.getvalue()
    if "== Final Plan ==" in text:
        text = text.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    else:
        text = text.split("== Physical Plan ==")[-1]
    lines = [ln for ln in text.strip("\n").splitlines() if ln.strip() and ln.strip() != "+-"]
    return textwrap.dedent("\n".join(shorten(ln) for ln in lines))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    out = argv[2] if len(argv) > 2 else os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md")
    spark = local_session(8)
    parts = ["# Physical plans\n",
             f"Final plans after adaptive execution, `local[8]`, tables at `{sf_dir}`.",
             "Generated by `scripts/dump_plans.py`; `*(n)` = whole-stage-codegen stage n.\n"]
    for q in CATALOGUE:
        df = q.build(spark, sf_dir)
        static_exchanges = count_exchanges(df)
        df.collect()  # run the DataFrame's own execution so AQE reports the final plan
        parts.append(f"## {q.name}\n")
        parts.append(f"Inventory: {', '.join(q.operators)}. Exchanges in the static plan: "
                     f"{static_exchanges}.\n")
        parts.append("```\n" + final_plan(df) + "\n```\n")
    spark.stop()
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    print(out)


if __name__ == "__main__":
    main(sys.argv)

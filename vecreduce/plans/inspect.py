"""Plan inspection through the public ``explain`` output.

Used by the tests to keep plans in the intended shape: no pairwise joins,
no row-at-a-time Python, pruned scans, pushed filters and a bounded number
of exchanges.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")
ROW_PYTHON = ("BatchEvalPython",)
ARROW_PYTHON = ("MapInPandas", "PythonMapInArrow", "ArrowEvalPython", "FlatMapGroupsInPandas")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def physical_section(text: str) -> str:
    """The operator tree of a formatted plan (before the per-node details)."""
    return text.split("\n\n(1)")[0]


def count_exchanges(df: DataFrame) -> int:
    tree = physical_section(plan_text(df))
    return len(re.findall(r"\bExchange\b", tree))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan_text(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\n]*)\]", plan_text(df))


def has_any(df: DataFrame, names) -> list[str]:
    text = plan_text(df)
    return [n for n in names if n in text]


def summary(df: DataFrame) -> dict:
    """The plan properties that decide behaviour at scale, from one ``explain``."""
    text = plan_text(df)
    return {
        "exchanges": len(re.findall(r"\bExchange\b", physical_section(text))),
        "pairwise_joins": [n for n in PAIRWISE if n in text],
        "row_python": [n for n in ROW_PYTHON if n in text],
        "arrow_python": [n for n in ARROW_PYTHON if n in text],
        "read_schemas": re.findall(r"ReadSchema: (struct<[^\n]*>)", text),
        "pushed_filters": [f for f in re.findall(r"PushedFilters: \[([^\n]*)\]", text) if f],
    }

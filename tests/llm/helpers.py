"""Small tables with every odd case, shared by the operator tests."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000

#: Columns named like the operators' own, which must do no harm.
CLASHING = ("id", "row", "salt", "digest", "n", "norm", "rank", "size", "kept", "fingerprint", "fp", "label",
            "spans", "items", "n_words", "n_hit", "score", "copies", "class", "target", "found", "pieces", "word", "at")


def docs(spark, rows):
    """``documents`` of ``(doc_id, text[, source[, lang]])``."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s0",
             None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    return spark.createDataFrame([
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, LONG, "en", "b", len(LONG)),
        (5, LONG.upper(), "en", "b", len(LONG)), (6, "The one", "en", None, 7), (7, "the ONE", None, "b", 7),
        (7, "the ONE", None, "b", 7), (None, "the one", "en", "b", 7), (None, None, None, None, None),
        (8, "été 😀 naïve ÉTÉ", "fr", "a", 15)], DOCS)


def with_clashing_columns(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df):
    return [tuple(r) for r in df.collect()]

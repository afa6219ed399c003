"""Compare a catalogue query with its SQL oracle in DuckDB.

Checks what the round driver checks: column names, column types, row count
and an order-insensitive comparison of all values.  Used by the tests and by
``scripts/check_oracle.py``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.tables import TABLES, table_path

_DUCK_TO_SPARK = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "FLOAT": "float", "BOOLEAN": "boolean", "SMALLINT": "smallint", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "HUGEINT": "hugeint",
}


@dataclass
class Outcome:
    name: str
    ok: bool
    detail: str
    rows: int = 0


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, int):
        return (1, v)
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (1, v) if v.is_integer() and abs(v) < 2 ** 53 else (3, v)
    return (4, str(v))


def _rows(records, order):
    return sorted(tuple(_norm(r[c]) for c in order) for r in records)


def compare(name: str, df: DataFrame, sql: str, con) -> Outcome:
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql)
    duck_types = {c: _DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    if sorted(spark_types) != sorted(duck_types):
        return Outcome(name, False, f"columns differ: spark {sorted(spark_types)} duck {sorted(duck_types)}")
    if spark_types != duck_types:
        diff = {c: (spark_types[c], duck_types[c]) for c in spark_types if spark_types[c] != duck_types[c]}
        return Outcome(name, False, f"types differ (spark, duck): {diff}")
    order = sorted(spark_types)
    s_rows = _rows([r.asDict() for r in df.collect()], order)
    d_raw = rel.fetchall()
    d_rows = _rows([dict(zip(rel.columns, r)) for r in d_raw], order)
    if len(s_rows) != len(d_rows):
        return Outcome(name, False, f"row count spark {len(s_rows)} duck {len(d_rows)}", len(s_rows))
    for a, b in zip(s_rows, d_rows):
        if a != b:
            return Outcome(name, False, f"first differing row: spark {a} duck {b}", len(s_rows))
    return Outcome(name, True, "match", len(s_rows))

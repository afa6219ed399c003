"""Exact deduplication by skew-safe combining.

1. *Local*: inside each Arrow batch, equal texts of one salt shrink to one row that
   carries their count.
2. *Salted*: those rows meet by (salt, digest).  The salt comes from the document id, so a
   text that fills a third of the table is spread over ``salts`` groups.
3. *Global*: the salt winners, at most ``salts`` for a text, meet by digest.

Each step compares whole normalised texts.  The 64-bit digest only decides where rows
meet: texts that merely share it stay apart.

Defined cases: a null text counts as the empty text, so null and empty texts are one
group.  A null id is smaller than any other.  Tables without rows give no rows.  Rows that
repeat the winner's id: ``surviving_rows`` returns one of them, ``duplicate_classes`` marks
all of them as kept, as they are the same document.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructType

from .common import ascii_lower, col, salt_of

SALTS = 64


def _digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _local_winners(batches: Iterator[pa.RecordBatch], text_col: str, digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        salts, ids, rows = (batch.column(i) for i in range(3))
        texts = pc.struct_field(rows, [rows.type.get_field_index(text_col)]).to_pylist()
        best: dict[tuple[int, bytes], int] = {}
        count: dict[tuple[int, bytes], int] = {}
        id_list = ids.to_pylist()
        for i, (salt, text) in enumerate(zip(salts.to_pylist(), texts)):
            key = (salt, (text or "").encode().lower())
            at = best.get(key)
            if at is None or (id_list[i] is not None and (id_list[at] is None or id_list[i] > id_list[at])):
                best[key] = i
            count[key] = count.get(key, 0) + 1
        take = pa.array(list(best.values()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [salts.take(take), pa.array([digest(k[1]) for k in best], pa.int64()),
             pa.array([count[k] for k in best], pa.int64()), ids.take(take), rows.take(take)],
            names=["salt", "digest", "n", "id", "row"])


def _combined(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Adds to each row its group's winner id and size, and whether it is the winner.

    Rows travel once, by ``keys``; the normalised ``text`` is computed where they meet, so
    each row carries its text once.
    """
    group = Window.partitionBy(*keys, "norm")
    ranked = group.orderBy(F.desc_nulls_last("id"))
    return (df.repartition(*keys).withColumn("norm", ascii_lower(F.coalesce(text, F.lit(""))))
            .withColumns({"rank": F.row_number().over(ranked), "keep_id": F.first("id").over(ranked),
                          "size": F.sum("n").over(group)}))


def _salt_winners(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    """One row for each salt and text, with ``keep_id`` and ``size`` of the whole group."""
    packed = docs.select(salt_of(col(id_col), salts).alias("salt"), col(id_col).alias("id"),
                         F.struct(*[col(c) for c in docs.columns]).alias("row"))
    schema = (StructType().add(packed.schema["salt"]).add("digest", LongType()).add("n", LongType())
              .add(packed.schema["id"]).add(packed.schema["row"]))
    local = packed.mapInArrow(lambda batches: _local_winners(batches, text_col, digest), schema)
    text = F.col("row").getField(text_col)
    salted = (_combined(local, ["salt", "digest"], text).where("rank = 1")
              .select("salt", "digest", F.col("size").alias("n"), "id", "row"))
    return _combined(salted, ["digest"], text)


def surviving_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   salts: int = SALTS, digest=_digest) -> DataFrame:
    """The row with the largest id of each group of equal texts, with all its columns."""
    return _salt_winners(docs, id_col, text_col, salts, digest).where("rank = 1").select("row.*")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      salts: int = SALTS, digest=_digest) -> DataFrame:
    """Each row's ``id, keep_id, group_size, kept, text_sha256``, dropped rows too.

    Groups come from the combining above.  Rows find their group by salt and SHA-256 of
    the normalised text, so a large group is read by ``salts`` tasks.
    """
    def sha(text):
        return F.sha2(text, 256)

    groups = (_salt_winners(docs.select(col(id_col).alias("id"), col(text_col).alias("text")),
                            "id", "text", salts, digest)
              .select("salt", sha(F.col("norm")).alias("text_sha256"), "keep_id",
                      F.col("size").alias("group_size")))
    rows = docs.select(col(id_col).alias("id"), salt_of(col(id_col), salts).alias("salt"),
                       sha(ascii_lower(F.coalesce(col(text_col), F.lit("")))).alias("text_sha256"))
    return rows.join(groups, ["salt", "text_sha256"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

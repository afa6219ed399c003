"""Helpers shared by the corpus operators.

Column names given by a caller are always quoted, and every operator first moves the
columns it needs under names of its own, so extra columns of any name do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """The column called exactly ``name`` (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """``text`` with only A-Z lower-cased.

    In a string of one byte per character ``lower`` changes nothing else and is much
    faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def salt_of(key: Column, salts: int) -> Column:
    """A number in [0, salts) that depends on the row's key only, so a rerun agrees."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a ``local`` session without one gets its own."""
    return scratch_path(spark, "llm").rpartition("/")[0]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage is cut.

    A lost executor then costs a reread, not a recomputation.  The files belong to the
    run and go when its shared folder is emptied.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """The place of one of the public tokenizers' files on the driver."""
    import public_tokenizers
    return public_tokenizers.path(name)


def chunks(batch: pa.RecordBatch, text_at: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``most_bytes``, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


class Remembered:
    """Values of pieces that recur, each computed once while it is remembered.

    ``compute`` takes a list of pieces, texts or bytes, and returns their values.  A piece
    and its value count as nine bytes a character, ``overhead`` and the value's own
    ``value_bytes``, where its size varies by more than that.  At half of
    ``most_bytes`` what was not asked for since the last time is forgotten, so memory is
    bounded by that and one call's pieces.
    """

    def __init__(self, compute: Callable[[list], list], most_bytes: int = 200_000_000, overhead: int = 180,
                 value_bytes: Callable[[object], int] | None = None):
        self.compute, self.most_bytes, self.overhead, self.value_bytes = compute, most_bytes, overhead, value_bytes
        self.recent: dict[Hashable, object] = {}
        self.older: dict[Hashable, object] = {}
        self.held = 0

    def of(self, pieces: list) -> Callable[[Hashable], object]:
        """A lookup that knows every one of ``pieces``."""
        needed = {p for p in pieces if p not in self.recent}
        if needed and 2 * self.held > self.most_bytes:
            self.older, self.recent, self.held = self.recent, {}, 0
            needed = set(pieces)
        missing = [p for p in needed if p not in self.older]
        if missing:
            self.recent.update(zip(missing, self.compute(missing)))
        if len(missing) < len(needed):
            self.recent.update((p, self.older[p]) for p in needed if p in self.older)
        self.held += 9 * sum(map(len, needed)) + self.overhead * len(needed)
        if self.value_bytes:
            self.held += sum(map(self.value_bytes, map(self.recent.__getitem__, needed)))
        return self.recent.__getitem__

"""Recoverable materialisation: a stored table with a manifest.

A cached table lives in executors and is computed again where one is lost.  A materialised
one is Parquet in a shared folder with a manifest of its schema, number of rows and digest,
written last.  A folder with a manifest is complete: a later call, also of another
application, takes it as it is, and a folder without one is written anew.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.datasource import filesystem


def row_digest(df: DataFrame) -> Column:
    """A row's 60-bit number: the first 15 hex digits of the MD5 of its columns as text, joined by ``|``.

    A null is ``\\N``.
    """
    text = [F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("\\N")) for c in df.columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame) -> DataFrame:
    """``(cnt, digest)``: the number of rows and the sum of their digests, whatever their order."""
    return df.agg(F.count(F.lit(1)).alias("cnt"),
                  F.coalesce(F.sum(row_digest(df).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))


@dataclass
class Materialised:
    """A stored table; ``reused`` tells whether an earlier call had stored it."""

    df: DataFrame
    path: str
    count: int
    digest: str
    reused: bool

    def verify(self) -> None:
        """Read the table again and fail if it is not what the manifest says."""
        found = fingerprint(self.df).first()
        if (found.cnt, found.digest) != (self.count, self.digest):
            raise RuntimeError(f"vecreduce: {self.path} has {found.cnt} rows and digest {found.digest}, "
                               f"its manifest says {self.count} and {self.digest}")

    def release(self) -> None:
        """Remove the stored table, its manifest first."""
        for part in ("manifest", "data"):
            system, inner = filesystem(f"{self.path}/{part}")
            system.delete_dir(inner)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        lines = spark.read.text(f"{path}/manifest").collect()  # one line
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return None
    return json.loads(lines[0].value) if lines else None


def materialise(df: DataFrame, path: str) -> Materialised:
    """``df`` stored at ``path``, or what an earlier call stored there.

    The folder must be one that all executors reach.  A stored table of another schema
    fails; it is never overwritten.
    """
    spark = df.sparkSession
    known = _manifest(spark, path)
    schema = df.schema.jsonValue()
    if known is not None and known["schema"] != schema:
        raise ValueError(f"vecreduce: {path} holds a table of another schema")
    reused = known is not None
    if not reused:
        df.write.mode("overwrite").parquet(f"{path}/data")
    stored = spark.read.schema(df.schema).parquet(f"{path}/data")
    if not reused:
        found = fingerprint(stored).first()
        known = {"schema": schema, "count": found.cnt, "digest": found.digest}
        spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return Materialised(stored, path, known["count"], known["digest"], reused)

"""Vectors cut into blocks: ``(worker, block, values)``, for vectors too wide for one row.

A block is ``width`` elements in fixed point, the last one of a vector may be shorter.  An
element-wise sum of blocks is one hash aggregate with an accumulator for each place of a
block, so it stays in generated code, combines in the map tasks, and ships a row a block
where the long form ships a row an element.  With ``levels`` the merge has the shape of a
tree: blocks are first merged within some salts, then across them, so no task merges a row
from every map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_point import EMBEDDING_SCALE, checked, col_of, exact_sum, from_fixed, to_fixed
from ..functions.ring import worker_of

WIDTH = 64


def to_blocks(df: DataFrame, vec: str = "embedding", key: str | None = "vec_id", n: int = 8, width: int = WIDTH,
              worker: str | None = None, scale: int = EMBEDDING_SCALE, on_invalid: str = "error",
              keep: Sequence[str] = ()) -> DataFrame:
    """``([keep...,] worker, block, values)``, a row for each block of each row's vector.

    A null, NaN or infinite element fails, or adds nothing (``"zero"``, ``"skip"``); a null
    vector or worker fails, or is left out.  An empty vector has one empty block.
    """
    if width < 1:
        raise ValueError("a block has at least one element")
    w = F.col(worker).cast("int") if worker else worker_of(key, n)
    v = F.col(vec)
    if on_invalid == "error":
        v = F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit("vecreduce: null vector")))
        w = F.when(w.isNotNull(), w).otherwise(F.raise_error(F.lit("vecreduce: null worker key")))
    else:
        df = df.where(w.isNotNull() & v.isNotNull())
    rule = "zero" if on_invalid == "skip" else on_invalid
    last = F.greatest(F.ceil(F.size("v") / F.lit(width)).cast("int") - 1, F.lit(0))
    rows = df.select(*keep, w.alias("worker"), v.alias("v"))
    cut = rows.select(*keep, "worker", "v", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    values = F.transform(F.slice("v", F.col("block") * width + 1, F.lit(width)),
                         lambda x: to_fixed(checked(x, rule), scale))
    return cut.select(*keep, "worker", "block", values.alias("values"))


def sum_of_blocks(values: str | Column, width: int = WIDTH) -> Column:
    """Element-wise sum of arrays of at most ``width`` BIGINTs; a sum beyond BIGINT fails."""
    v = col_of(values)
    longest = F.max(F.size(v))
    beyond = F.raise_error(F.lit("vecreduce: sum exceeds BIGINT; use a smaller scale")).cast("long")
    sums = []
    for i in range(width):
        total = F.try_sum(F.get(v, F.lit(i)))
        sums.append(F.when(total.isNull() & (longest > i), beyond).otherwise(total))
    too_long = F.raise_error(F.lit(f"vecreduce: a block of more than {width} elements")).cast("array<bigint>")
    return F.when(longest > width, too_long).otherwise(F.slice(F.array(*sums), F.lit(1), longest))


def block_all_reduce(blocks: DataFrame, by: Sequence[str] = (), values: str = "values", name: str = "total",
                     width: int = WIDTH, levels: Sequence[int] = ()) -> DataFrame:
    """Element-wise sum of all workers' blocks: ``([by...,] block, total)``.

    ``levels`` are the numbers of salts of the levels before the last, e.g. ``(64,)``: a
    salt is a map task's number modulo that, so each level merges by that factor less.
    Sums are exact, so the result does not depend on the levels.
    """
    by = list(by)
    for salts in levels:
        salted = blocks.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        blocks = salted.groupBy(*by, "block", "_salt").agg(sum_of_blocks(values, width).alias(values)).drop("_salt")
    return blocks.groupBy(*by, "block").agg(sum_of_blocks(values, width).alias(name))


def block_stats(df: DataFrame, vec: str, loss: Column | str, width: int = WIDTH, scale: int = EMBEDDING_SCALE,
                loss_scale: int = EMBEDDING_SCALE, on_invalid: str = "error", levels: Sequence[int] = ()) -> DataFrame:
    """The triple over blocks: ``(block, grad, loss, cnt)``.

    ``grad`` is the block's totals in fixed point; ``loss`` (a double) and ``cnt`` are of
    all rows.  They travel with each row's first block through the same aggregate, and are
    then joined back to all blocks as one row.
    """
    own = F.col(vec)
    if on_invalid != "error":  # a null vector adds nothing, its row still counts
        own = F.coalesce(own, F.array().cast(df.schema[vec].dataType))
    rows = df.select(own.alias("_vec"), to_fixed(checked(loss, on_invalid), loss_scale).alias("_loss"),
                     F.lit(0).alias("_worker"))
    blocks = to_blocks(rows, "_vec", worker="_worker", key=None, width=width, scale=scale, on_invalid=on_invalid,
                       keep=("_loss",))
    first = F.col("block") == 0
    blocks = blocks.select("block", "values", F.when(first, F.col("_loss")).alias("_loss"),
                           F.when(first, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("_cnt"))
    stats = [sum_of_blocks("values", width).alias("values"), F.sum("_cnt").alias("_cnt"),
             exact_sum("_loss").alias("_loss")]
    for salts in levels:
        salted = blocks.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        blocks = salted.groupBy("block", "_salt").agg(*stats).drop("_salt")
    merged = blocks.groupBy("block").agg(*stats).withColumn("_all", F.pmod("block", F.lit(1)))  # 0: one key
    whole = merged.where("block = 0").select("_all", F.col("_loss").alias("_total"), F.col("_cnt").alias("cnt"))
    joined = merged.select("_all", "block", "values").join(F.broadcast(whole), "_all")  # one row
    return joined.select("block", F.col("values").alias("grad"), from_fixed("_total", loss_scale).alias("loss"), "cnt")


def blocks_to_dims(blocks: DataFrame, values: str = "total", name: str | None = None, width: int = WIDTH,
                   keep: Sequence[str] = ()) -> DataFrame:
    """One row an element: ``([keep...,] dim, value)``."""
    cells = blocks.select(*keep, "block", F.posexplode(values).alias("_at", name or values))
    return cells.select(*keep, (F.col("block") * width + F.col("_at")).cast("int").alias("dim"), name or values)


def dims_to_blocks(cells: DataFrame, value: str, name: str | None = None, width: int = WIDTH, dim: str = "dim",
                   keep: Sequence[str] = ()) -> DataFrame:
    """``([keep...,] block, values)`` of one row an element.

    A block collects at most ``width`` cells.  Its elements must be its first ones, each
    once: a gap or a repeated element fails instead of shifting the others.
    """
    at = F.pmod(F.col(dim), F.lit(width)).cast("int")
    cut = cells.select(*keep, F.floor(F.col(dim) / F.lit(width)).cast("int").alias("block"),
                       F.struct(at.alias("at"), F.col(value).alias("v")).alias("_cell"))
    found = F.array_sort(F.collect_list("_cell"))
    in_order = found.getField("at") == F.sequence(F.lit(0), F.size(found) - 1)
    values = F.when(in_order, found.getField("v")).otherwise(
        F.raise_error(F.lit("vecreduce: a block with a gap or a repeated element")))
    return cut.groupBy(*keep, "block").agg(values.alias(name or value))

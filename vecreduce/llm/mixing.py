"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Sources get targets in words: shares of the whole by weight, where a source's target stops
at ``most`` times its size and what is left over is shared again by weight.

Rates of documents are the closest to 1 in relative entropy that meet the targets with no
rate above ``most``.  The solution is an exponential tilt, ``min(most, exp(t * z))`` with z
the document's size over its source's mean size.  The convex dual has one multiplier t for
each source's token constraint.  Newton's method finds them: an iteration is one
distributed aggregate over the table of (source, size, documents), guarded by bisection.

Rates are rounded to whole copies by a hash of the document id, from the longest documents
to the shortest: after each class of sizes, the rates of the smaller documents are scaled
so that they make up for what rounding gave or took.  What is still missing then is made up by
moving a source's hashes: of all documents those whose hash lies nearest to their fraction
change by one copy, as many as bring the source nearest to its target.  So a source misses
its target by about half of one document.

Tables of sources have one row for each source.  The sources are counted once; documents
meet them in a join that broadcasts a table of at most ``MOST_SOURCES`` rows.  Beyond that
they are shuffled, and a source's documents are split among ``SALTS`` salts.  Only the table of
sources itself is ranked in one task.

Defined cases: null texts have size 0 and are taken 0 times, as all empty ones.  A null
source is a source, the last in order.  A source without words has target 0.  Rows that
repeat an id are rounded alike.  Reruns agree.  Very long texts count all their words.  An
empty table gives an empty result; extra columns stay in the mix and are not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 10_000
SALTS = 64
TOLERANCE = 1e-6
MAX_ROUNDS = 60
_SHIFT_POINTS = 32
_SHIFT_ROUNDS = 5
_BASE = 4  # documents are rounded in classes of sizes [4^c, 4^(c + 1))


def size_of(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``source, source_size, target``; ``sizes`` has ``source, size``.

    Sources in code point order, null last, take the weights in turn.  With sources sorted
    by the level at which they reach their bound, the final level is the largest of the
    levels that the remaining weights and words give.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order, everything = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))),
                          (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("bound") / F.col("weight"), "weight", F.asc_nulls_last("source")).rowsBetween(
        Window.unboundedPreceding, -1)
    left = (F.lit(float(share)) * F.sum("source_size").over(everything)
            - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (sources.withColumn("level", left / left_weight)
            .withColumn("level", F.max("level").over(everything))
            .select("source", "source_size",
                    F.least("bound", F.col("weight") * F.col("level")).alias("target")))


def _rate(most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))


class BySource:
    """Joins with tables of one row for each source; null is a source.

    A table too long to broadcast is joined by shuffle.  Documents, the rows with an ``id``, are then
    salted by id and size, and each (source, salt) that occurs gets a copy of its source's row.
    """

    def __init__(self, sources: DataFrame):
        self.small = sources.count() <= MOST_SOURCES

    def __call__(self, left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        named = right.withColumnRenamed("source", "of_source")
        same = F.col("source").eqNullSafe(F.col("of_source"))
        if self.small or "id" not in left.columns:
            return left.join(F.broadcast(named) if self.small else named, same, how).drop("of_source")
        salted = left.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int"))
        copies = (salted.select("source", "salt").distinct().join(named, same)
                  .drop("source").withColumnRenamed("salt", "of_salt"))
        return (salted.join(copies, same & (F.col("salt") == F.col("of_salt")), how)
                .drop("of_source", "of_salt", "salt"))


def tilts(counts: DataFrame, wanted: DataFrame, by_source: BySource, most: float = MOST, tolerance: float = TOLERANCE,
          max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``source, source_size, target, mean, tilt`` of the sources with words.

    ``counts`` has ``source, size, documents``.  The dual is solved from tilt 0 within a
    bracket in which the words taken pass the target: at ``low`` the shortest document's
    rate is the target's share of the source, at ``high`` even that rate is ``most``.
    """
    stats = counts.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("documents")) / F.sum("documents")).alias("mean"),
        F.min("size").alias("shortest"))
    unit = F.col("mean") / F.col("shortest")
    ratio = F.col("target") / F.col("source_size")
    state = (by_source(wanted.where("source_size > 0"), stats)
             .withColumn("low", F.least(F.lit(0.0), F.log(ratio) * unit))
             .withColumn("high", F.lit(math.log(most)) * unit)
             .withColumn("tilt", F.when(ratio >= most, F.col("high")).otherwise(F.lit(0.0)))
             .select("source", "source_size", "target", "mean", "low", "high", "tilt"))
    state = saved(state, "mixing-tilts")
    for _ in range(max_rounds):
        words = F.col("documents") * F.col("size")
        rate = _rate(most)
        sums = (by_source(counts, state.select("source", "mean", "tilt")).groupBy("source").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")))
        step = F.col("tilt") - F.try_divide(F.col("taken") - F.col("target"), F.col("slope"))
        at = by_source(state, sums)
        over = F.col("taken") > F.col("target")
        at = (at.withColumn("error", F.abs(F.col("taken") / F.col("target") - 1))
              .withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
              .withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high")))
              .withColumn("next", F.when((step > F.col("low")) & (step < F.col("high")), step)
                          .otherwise((F.col("low") + F.col("high")) / 2))
              .withColumn("tilt", F.when(F.col("error") <= tolerance, F.col("tilt")).otherwise(F.col("next")))
              .select(*state.columns, "error"))
        at = saved(at, "mixing-tilts")
        state = at.drop("error")
        if at.where(F.col("error") > tolerance).isEmpty():
            break
    return state.drop("low", "high")


def _class(size: str = "size") -> Column:
    """The class of a size, by integer powers so that no rounding of logarithms matters."""
    return F.expr(f"size(filter(transform(sequence(1, 31), c -> shiftleft(1L, 2 * c)), b -> b <= {size}))")


def _copies(most: float, shift: Column | None = None) -> Column:
    """Whole copies: the scaled rate, rounded up where the id's hash falls below its fraction and the ``shift``."""
    scale = F.coalesce(F.get("scales", F.col("class")), F.lit(0.0))
    rate = F.least(F.lit(most), F.greatest(F.lit(0.0), _rate(most) * scale))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("copies")), 11) / F.lit(float(1 << 53))
    part = rate - F.floor(rate)
    copies = F.floor(rate) + F.when(draw < (part if shift is None else part + shift), 1).otherwise(0)
    return (copies if shift is None else F.least(F.lit(math.ceil(most)), copies)).cast("long")


def rounded(sizes: DataFrame, counts: DataFrame, state: DataFrame, by_source: BySource,
            most: float = MOST) -> DataFrame:
    """``source, mean, tilt, scales``: what the rates of each class of sizes are multiplied by.

    Classes are settled from the largest sizes down.  A class's scale is what is still
    wanted over what the rates give from this class down; then its documents are rounded.
    """
    classes = (counts.agg(F.max(_class()).alias("c")).first()["c"] or 0) + 1
    per_class = [F.sum(F.when(_class() <= c, F.col("documents") * F.col("size") * _rate(most)).otherwise(0.0))
                 .alias(f"from_{c}") for c in range(classes)]
    given = by_source(counts, state.select("source", "mean", "tilt")).groupBy("source").agg(*per_class)
    state = saved(by_source(state, given).withColumn("open", F.col("target"))
                  .withColumn("scales", F.array(*[F.lit(0.0)] * classes)), "mixing-scales")
    for c in reversed(range(classes)):
        scale = F.coalesce(F.try_divide(F.greatest("open", F.lit(0.0)), F.col(f"from_{c}")), F.lit(0.0))
        state = state.withColumn("scales", F.transform(
            "scales", lambda x, i: F.when(i == c, scale).otherwise(x)))
        if c == 0:  # nothing is left to make up for the smallest class
            break
        members = sizes.where((F.col("size") >= _BASE ** c) & (F.col("size") < _BASE ** (c + 1)))
        taken = (by_source(members.withColumn("class", F.lit(c)), state.select("source", "mean", "tilt", "scales"))
                 .groupBy("source").agg(F.sum(F.col("size") * _copies(most)).alias("taken")))
        state = saved(by_source(state, taken, "left")
                      .withColumn("open", F.col("open") - F.coalesce("taken", F.lit(0))).drop("taken"), "mixing-scales")
    return state.select("source", "mean", "tilt", "scales")


def settled(sizes: DataFrame, scales: DataFrame, wanted: DataFrame, by_source: BySource,
            most: float = MOST) -> DataFrame:
    """``scales`` with ``shift``: how far a source's hashes move so that it comes nearest to its target.

    The words taken grow with the shift.  A round takes them at points between two shifts
    that enclose the target, and goes on between the two next to it.
    """
    members = sizes.where("size > 0").withColumn("class", _class())
    state = by_source(scales, wanted.select("source", "target")).withColumns(
        {"low": F.lit(-1.0), "high": F.lit(1.0), "taken_low": F.lit(0).cast("long"), "taken_high": F.lit(0).cast("long")})
    names = state.columns
    step = (F.col("high") - F.col("low")) / _SHIFT_POINTS
    for _ in range(_SHIFT_ROUNDS):
        sums = by_source(members, state.drop("target", "taken_low", "taken_high")).groupBy("source").agg(F.array(*[
            F.sum(F.col("size") * _copies(most, F.col("low") + step * k)) for k in range(_SHIFT_POINTS + 1)]).alias("taken"))
        at = by_source(state, sums)
        below = F.size(F.filter("taken", lambda t: t <= F.col("target")))
        first, last = F.greatest(below - 1, F.lit(0)), F.least(below, F.lit(_SHIFT_POINTS))
        state = saved(at.withColumns({
            "taken_low": F.get("taken", first), "taken_high": F.get("taken", last),
            "low": F.col("low") + step * first, "high": F.col("low") + step * last}).select(*names), "mixing-shifts")
    nearer = F.abs(F.col("taken_low") - F.col("target")) <= F.abs(F.col("taken_high") - F.col("target"))
    return state.withColumn("shift", F.when(nearer, F.col("low")).otherwise(F.col("high"))).select(
        "source", "mean", "tilt", "scales", "shift")


def _plan(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, BySource]:
    """Each source's size and target, and for sources with words the tilt and the scales."""
    wanted = saved(targets(sizes, weights, share, most), "mixing-targets")
    by_source = BySource(wanted)
    counts = saved(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("documents")),
                   "mixing-counts")
    scales = rounded(sizes, counts, tilts(counts, wanted, by_source, most), by_source, most)
    shifts = settled(sizes, saved(scales, "mixing-scales"), wanted, by_source, most)
    return saved(by_source(wanted, shifts, "left"), "mixing-plan"), by_source


def _with_copies(sized: DataFrame, plan: DataFrame, by_source: BySource, most: float) -> DataFrame:
    """``sized`` (``id, source, size, ...``) with ``source_size, target, copies``."""
    return (by_source(sized, plan).withColumn("class", _class())
            .withColumn("copies", F.when(F.col("size") > 0, _copies(most, F.col("shift"))).otherwise(0).cast("long")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``id, size, source_size, target, copies, taken`` of every row."""
    sizes = saved(docs.select(col(id_col).alias("id"), col(source_col).alias("source"),
                              size_of(col(text_col)).alias("size")), "mixing-sizes")
    return _with_copies(sizes, *_plan(sizes, weights, share, most), most).select(
        "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copied(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           copy_col: str = "copy", weights: Sequence[float] = WEIGHTS, share: float = SHARE,
           most: float = MOST) -> DataFrame:
    """The mix itself: each row as often as it is taken, numbered from 1 in ``copy_col``.

    If ``docs`` has such a column, underscores are put behind the new one's name until it is free.
    """
    while copy_col.lower() in {c.lower() for c in docs.columns}:
        copy_col += "_"
    def sized(*more):
        return docs.select(col(id_col).alias("id"), col(source_col).alias("source"),
                           size_of(col(text_col)).alias("size"), *more)

    plan = _plan(saved(sized(), "mixing-sizes"), weights, share, most)
    rows = _with_copies(sized(F.struct(*[col(c) for c in docs.columns]).alias("row")), *plan, most)
    return (rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
                                            .alias("number"))
            .select("row.*", F.col("number").alias(copy_col)))

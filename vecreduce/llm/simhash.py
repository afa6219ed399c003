"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint is the bitwise majority of its shingles' 64-bit hashes.  The 64
bits are split into four blocks.  Fingerprints that differ in at most two bits agree in at
least two blocks, so each fingerprint enters six buckets, one for each pair of blocks, and
pairs that meet in a bucket are verified by their Hamming distance.

Only distinct fingerprints are compared, whatever the number of their documents.  A bucket
with more than ``bucket_limit`` distinct fingerprints is not joined with itself: its
members are linked by shared centres instead.  Two fingerprints are within two bits
exactly if one value is within one bit of both, and at most 65 fingerprints are within one
bit of a value, so that way is exact, linear and free of hot groups.

Linked fingerprints form components by minimum labels with pointer jumping.  The labels of a
large component are read by many tasks, as every lookup salts its keys.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other.
Texts with fewer words than the shingle length have one shingle, all their words.
Components take the smallest non-null id; rows that repeat an id all get its component.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from .common import col, salt_of, saved

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BUCKET_LIMIT = 32
SALTS = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text: bits set in over half its shingle hashes.

    Words are runs without ASCII white space, A-Z lower-cased; repeated shingles count.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle_words, len(words))
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends[k - 1:])], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``id, fingerprint`` of every row; the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle_words, seed) for t in batch.column(1)),
                                 dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))],
                                             names=["id", "fingerprint"])

    given = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return given.mapInArrow(run, StructType().add(given.schema["id"]).add("fingerprint", LongType()))


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``a < b`` between distinct fingerprints (column ``fp``) of at most two bits.

    Every pair within ``max_bits`` is joined by links of ``max_bits`` at most: in ordinary
    buckets by its own, in crowded ones possibly over others.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("four blocks taken two at a time find pairs of at most two differing bits")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    block = "(shiftrightunsigned(fp, {}) & 65535L)".format
    keys = ", ".join(f"shiftleft({p}L, 32) | shiftleft({block(16 * i)}, 16) | {block(16 * j)}"
                     for p, (i, j) in enumerate(pairs))
    entries = prints.select("fp", F.explode(F.expr(f"array({keys})")).alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    entries = saved(entries.join(sizes, "bucket"), "simhash-buckets")
    usual, crowded = (entries.where(f"members {op} {bucket_limit}") for op in ("<=", ">"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    direct = (usual.select("bucket", F.col("fp").alias("a"))
              .join(usual.select("bucket", F.col("fp").alias("b")), "bucket")
              .where(F.col("a") < F.col("b")).where(close).select("a", "b"))
    return direct.unionByName(_star_links(crowded, max_bits).where(close)).distinct()


def _star_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links among the fingerprints of crowded buckets, at most 65 rows for each of them."""
    members = crowded.select("fp").distinct()
    balls = members.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("centre"))
    if max_bits < 2:  # one bit apart: a centre that is a member itself
        return (balls.where("fp < centre").join(members.select(F.col("fp").alias("centre")), "centre")
                .select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    first = balls.groupBy("centre").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last")
    return balls.join(first, "centre").where("fp > a").select("a", F.col("fp").alias("b"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, salt_by: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``table``'s row of their ``key``.

    Rows are salted by another column of theirs, so a key that very many rows share is
    read by ``salts`` tasks, each with one copy of the table's row.  ``rows`` is read twice.
    """
    salted = rows.withColumn("salt", salt_of(F.col(salt_by), salts))
    copies = salted.select(key, "salt").distinct().join(table, key)
    return salted.join(copies, [key, "salt"]).drop("salt")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``: the least node reachable.

    A round takes the least label among a node and its neighbours, then jumps to that
    label's own label.  It ends when the two ends of every edge agree.
    """
    edges = saved(edges, "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(both.groupBy("a").agg(F.min("b").alias("least"))
                   .select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    for _ in range(max_rounds):
        at_a = edges.join(labels, edges.a == labels.node).select("b", F.col("label").alias("of_a"))
        apart = at_a.join(labels, at_a.b == labels.node).where("of_a <> label")
        if apart.isEmpty():
            return labels
        offered = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("offer"))
        better = saved(labels.join(offered, labels.node == offered.a)
                       .select("node", F.least("label", "offer").alias("label")), "labels")
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = saved(looked_up(better, "label", jump, "node")
                       .select("node", F.least("label", "further").alias("label")), "labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED,
                           bucket_limit: int = BUCKET_LIMIT, salts: int = SALTS) -> DataFrame:
    """``id, fingerprint, component_id`` of every row; component_id is the least id reachable.

    Rows find their component by fingerprint and a salt of their id, so one fingerprint
    that many documents share is read by ``salts`` tasks.
    """
    prints = saved(fingerprints(docs, id_col, text_col, shingle_words, seed), "fingerprints")
    prints = prints.withColumn("salt", salt_of(F.col("id"), salts))
    salted = prints.groupBy("fingerprint", "salt").agg(F.min("id").alias("id"))
    distinct = saved(salted.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least")), "distinct")
    labels = components(links(distinct.select("fp"), max_bits, bucket_limit))
    linked = saved(distinct.join(labels, distinct.fp == labels.node).select("fp", "label", "least"), "linked")
    least = linked.groupBy("label").agg(F.min("least").alias("of_component"))
    found = (distinct.join(looked_up(linked, "label", least, "fp").select("fp", "of_component"), "fp", "left")
             .select("fp", F.coalesce("of_component", "least").alias("component_id")))
    by_salt = (salted.join(found, salted.fingerprint == found.fp)
               .select(salted.fingerprint, "salt", "component_id"))
    return prints.join(by_salt, ["fingerprint", "salt"]).select("id", "fingerprint", "component_id")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their component's least; rows without an id stay.

    Only ids are compared with ids: the texts move once, in the join that keeps rows.
    """
    found = near_duplicate_classes(docs, id_col, text_col, **options)
    free = "kept_id"
    while free.lower() in {c.lower() for c in docs.columns}:
        free += "_"
    kept = found.where("id = component_id").select(F.col("id").alias(free)).distinct()
    named = docs.where(col(id_col).isNotNull()).join(kept, col(id_col) == col(free), "left_semi")
    return named.unionByName(docs.where(col(id_col).isNull()))

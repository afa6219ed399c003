"""URL filters over a memory-mapped, sorted array of rule digests.

A rule is a host, a path and a verdict.  It fits its host and all subdomains if the URL's
path starts with the rule's path; the longest fitting rule wins, the one with the longer
host of equally long ones.  Without a fitting rule the verdict is the filter's default.

The rules become one file: their 64-bit xxhash keys in order, the places of their strings,
and the strings.  Spark distributes the file to every executor, which maps it into memory
once for all its workers.  A batch of URLs is probed at once: all candidate (host suffix,
path prefix) keys by binary search, and each hit is confirmed by the stored string, so
keys that merely collide do no harm.

The file holds at most ``MOST_BYTES`` of rules, which is checked.  More rules than that
are joined with the URLs' candidates by key and string instead (``verdicts_by_join``).

Defined cases: a null URL, or one without ``://``, has an empty host and path, and no rule
fits it but one with an empty host and path.  Rules with a null host are left out; a null
path is empty.  Of rules with the same host and path the blocking one counts.  A very long
URL costs in proportion to its length: only suffixes of as many labels as some rule's are
probed.  Empty tables give empty results; extra columns, of any name, are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import ascii_lower, col, shared_folder

MOST_BYTES = 64 << 20
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEPARATOR = "\t"


def split_url(url: str | None) -> tuple[str, str]:
    """``(host, path)``: the host lower-cased, both as they stand in the URL."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _key(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(host + _SEPARATOR + path)


def packed(rules: list[tuple[str, str, str]]) -> bytes:
    """The file of ``(host, path, verdict)`` rules: counts, sizes that occur, sorted keys, places, strings."""
    unique: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        at = (host, path)
        unique[at] = "block" if "block" in (verdict, unique.get(at)) else verdict
    ordered = sorted((_key(*at), _SEPARATOR.join((*at, verdict)).encode()) for at, verdict in unique.items())
    lengths = sorted({len(path) for _, path in unique})
    labels = sorted({host.count(".") + 1 for host, _ in unique})
    places = np.cumsum([0] + [len(text) for _, text in ordered], dtype="<u8")
    return b"".join([np.array([len(ordered), len(lengths), len(labels)], dtype="<u8").tobytes(),
                     np.array(lengths + labels, dtype="<u8").tobytes(),
                     np.array([key for key, _ in ordered], dtype="<u8").tobytes(),
                     places.tobytes(), b"".join(text for _, text in ordered)])


class Rules:
    """A packed file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        count, widths, depths = data[:24].view("<u8").tolist()
        at = 24
        self.path_lengths = data[at:at + 8 * widths].view("<u8").tolist()
        at += 8 * widths
        self.label_counts = data[at:at + 8 * depths].view("<u8").tolist()
        at += 8 * depths
        self.keys = data[at:at + 8 * count].view("<u8")
        at += 8 * count
        self.places = data[at:at + 8 * (count + 1)].view("<u8")
        self.strings = data[at + 8 * (count + 1):]

    def _confirmed(self, at: int, host: str, path: str) -> str | None:
        """The verdict of the stored rule of exactly this host and path, from place ``at`` on."""
        while at < len(self.keys) and self.keys[at] == _key(host, path):
            text = self.strings[int(self.places[at]):int(self.places[at + 1])].tobytes().decode()
            own, _, verdict = text.rpartition(_SEPARATOR)
            if own == host + _SEPARATOR + path:
                return verdict
            at += 1
        return None

    def __call__(self, urls: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """``(rule, verdict)`` of each host and path, or None."""
        candidates = [(i, host, path) for i, at in enumerate(urls) for host, path in _candidates(
            *at, self.path_lengths, self.label_counts)]
        keys = np.array([_key(host, path) for _, host, path in candidates], dtype="<u8")
        places = np.searchsorted(self.keys, keys)
        inside = places < len(self.keys)
        hits = np.flatnonzero(inside)[self.keys[places[inside]] == keys[inside]] if len(self.keys) else []
        best: list[tuple[tuple[int, int], str, str] | None] = [None] * len(urls)
        for c in hits:
            i, host, path = candidates[c]
            verdict = self._confirmed(int(places[c]), host, path)
            rank = (len(host) + len(path), len(host))
            if verdict is not None and (best[i] is None or rank > best[i][0]):
                best[i] = (rank, host + path, verdict)
        return [None if b is None else b[1:] for b in best]


def _candidates(host: str, path: str, path_lengths: list[int], label_counts: list[int]) -> Iterator[tuple[str, str]]:
    """Every suffix of the host of as many labels as some rule's, with every prefix of the path as long as some rule's."""
    labels = host.split(".")
    for many in label_counts:
        if many > len(labels):
            break
        suffix = ".".join(labels[-many:])
        for length in path_lengths:
            if length > len(path):
                break
            yield suffix, path[:length]


def _rule_table(rules: DataFrame) -> DataFrame:
    return rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                        "verdict").where("host is not null and verdict in ('allow', 'block')")


def _shipped(spark: SparkSession, rules: DataFrame) -> str:
    """Packs the rules, puts the file in the shared folder and has Spark send it to all executors."""
    data = packed([(r.host, r.path, r.verdict) for r in rules.collect()])
    name = f"url-rules-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_RULES: dict[str, Rules] = {}  # of this worker


def verdicts(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
             default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``id, host, path, rule, verdict`` of every row; ``rules`` has ``host, path, verdict``."""
    rules = _rule_table(rules)
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.lit(24))).first()[0] or 0
    if size > most_bytes:
        return verdicts_by_join(urls, rules, id_col, url_col, default)
    name = _shipped(urls.sparkSession, rules)
    given = urls.select(col(id_col).alias("id"), col(url_col).alias("url"))
    schema = StructType().add(given.schema["id"])
    for column in ("host", "path", "rule", "verdict"):
        schema = schema.add(column, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _RULES:
            _RULES.clear()
            _RULES[name] = Rules(SparkFiles.get(name))
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            found = _RULES[name](split)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (
                    [h for h, _ in split], [p for _, p in split], [f and f[0] for f in found],
                    [f[1] if f else default for f in found]))], names=schema.names)

    return given.mapInArrow(run, schema)


def verdicts_by_join(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                     default: str = "allow") -> DataFrame:
    """The same for rules of any number: candidates meet rules by host and path in a shuffled join.

    Distinct hosts and paths are matched once, however many rows share them.  The lengths of
    the rules' paths and the label counts of their hosts come to the driver: no more numbers
    than the longest path and host have characters.
    """
    rules = _rule_table(rules).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r.n for r in rules.select(F.char_length("path").alias("n")).distinct().collect())
    counts = sorted(r.n for r in rules.select(F.size(F.split("host", "[.]")).alias("n")).distinct().collect())
    deep = "filter(array({}), k -> k <= size(labels))".format(", ".join(map(str, counts)) or "cast(null as int)")
    fitting = "filter(array({}), x -> x <= char_length(path))".format(", ".join(map(str, lengths)) or "cast(null as int)")
    given = urls.select(
        col(id_col).alias("id"), F.expr("coalesce(regexp_extract(`{0}`, '(?s)://([^/?#]*)', 1), '')".format(
            url_col.replace("`", "``"))).alias("raw"),
        F.coalesce(F.regexp_extract(col(url_col), r"(?s)://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    given = given.select("id", ascii_lower(F.col("raw")).alias("host"), "path")
    distinct = given.select("host", "path").distinct()
    candidates = (
        distinct.withColumn("labels", F.split("host", "[.]"))
        .select("host", "path", F.explode(F.expr(
            f"transform({deep}, k -> array_join(slice(labels, -k, k), '.'))")).alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.expr(fitting)).alias("n"))
        .select("host", "path", "suffix", F.expr("left(path, n)").alias("prefix")))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    best = (candidates.join(named, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max(F.struct(
        (F.char_length("suffix") + F.char_length("prefix")).alias("size"), F.char_length("suffix").alias("host_size"),
        F.concat("suffix", "prefix").alias("rule"), "verdict")).alias("best")))
    return given.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

"""Ranked lexical search by hybrid TAAT-DAAT.

A stated set of items is matched against all documents, in three steps:

1. ``term_counts`` reads every document once: how many terms it has, and how often each
   term that some item holds occurs in it.  The table is saved.  The corpus figures and a
   term's documents are counted from it.
2. Each task takes its documents in segments of bounded size and turns a segment into
   inverted lists: for a term its documents in order of id, with what the term adds to
   each document's score.  An item's short lists are summed term-at-a-time into one list
   of accumulators.  That list then is one more iterator, with its own bound, when the
   long lists are read document-at-a-time: blocks of documents are taken in order, a block
   whose bounds together cannot reach the least of the best scores so far is skipped
   unread.  In a block, lists are read in order of their bounds, until the others together
   could not bring in a document that no list read so far holds; of the documents found,
   those that can still reach that score are completed by binary search in the other lists.
3. Each task keeps the best ``k`` of each item over its segments, and the best of all tasks
   are merged by a salted window: an item brings ``k`` rows a task.

Items are taken in blocks of ``block_bytes`` of text, measured; a block's terms are sent to
all tasks.  Memory: a segment's ``segment_postings``, a block's terms, and ``k`` rows an
item.  Documents never meet in a task by key, so no source or copied text is a hot key.

Scores are 64-bit integers, so they do not depend on the order of addition.

Defined cases: null, empty and termless documents count for nothing and are never found;
items without terms find nothing.  A term that an item repeats counts once.  Equal scores
go by ascending id, a null id last.  Rows that repeat an id are documents of their own, and
rows that repeat an item are items of their own.  Empty tables give an empty result.  Very
long texts are read whole; one of more postings than a segment makes a segment alone.
Extra columns, of any name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import col, saved

K = 10
BLOCK_BYTES = 16_000_000
SEGMENT_POSTINGS = 2_000_000
DOC_BLOCK = 512
SHORT_SHARE = 1 / 64
SALTS = 64

#: Terms are runs of digits, letters and all non-ASCII characters; A-Z are lower-cased.
_TERM_BYTE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTE).split() if text else []


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``id, n_terms, terms, times`` of every row, saved: its count of terms, and the numbers
    and occurrences of those in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    schema = StructType().add(given.schema["id"])
    for field in StructType.fromDDL("n_terms long, terms array<int>, times array<int>"):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, bounds, numbers, times = [], [0], [], []
            for text in batch.column(1):
                terms = terms_of(text.as_py())
                sizes.append(len(terms))
                known = [i for i in map(number, terms) if i is not None]
                found, count = np.unique(np.array(known, dtype=np.int32), return_counts=True)
                numbers.append(found)
                times.append(count)
                bounds.append(bounds[-1] + len(found))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(
                np.concatenate(v).astype(np.int32) if v else [], pa.int32())) for v in (numbers, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists],
                                             names=schema.names)

    return saved(given.mapInArrow(run, schema), "search-counts")


def term_weight(documents: int, of_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * of_term + 1)))


def gains(weight: np.ndarray, times: np.ndarray, size: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term adds to the score of a document of ``size`` terms, each argument an array."""
    if len(size) and 90 * int(size.max()) * documents >= 1 << 63:
        raise OverflowError("document length times documents exceeds 64 bits")
    m = 100 - 90 + (90 * size * documents) // all_terms
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * m))


class Segment:
    """The inverted lists of some documents, numbered in order of id."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, documents: int, all_terms: int,
                 doc_block: int = DOC_BLOCK, short_share: float = SHORT_SHARE):
        rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_end"))
        self.ids = rows["id"].combine_chunks()
        terms = rows["terms"].combine_chunks()
        doc = np.repeat(np.arange(len(self.ids)), np.diff(terms.offsets.to_numpy()))
        term = terms.flatten().to_numpy()
        times = rows["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        gain = gains(weights[term], times, rows["n_terms"].to_numpy()[doc], documents, all_terms)
        order = np.argsort(term, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.doc_block = doc_block
        self.edges = np.arange(0, len(self.ids) + doc_block, doc_block)
        self.short = max(1, int(len(self.ids) * short_share))
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _by_block(self, docs: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each block of documents begins in a list, and the most the list adds in it."""
        begin = np.searchsorted(docs, self.edges)
        most = np.zeros(len(self.edges) - 1, dtype=np.int64)
        some = np.flatnonzero(begin[1:] > begin[:-1])
        if len(some):
            most[some] = np.maximum.reduceat(gain, begin[some])
        return begin, most

    def _list(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        docs = self.doc[self.starts[term]:self.starts[term + 1]]
        gain = self.gain[self.starts[term]:self.starts[term + 1]]
        if term not in self._blocks:
            self._blocks[term] = self._by_block(docs, gain)
        return docs, gain, *self._blocks[term]

    def _accumulated(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the terms' lists, term-at-a-time: documents in order, and their scores."""
        docs = np.concatenate([self.doc[self.starts[t]:self.starts[t + 1]] for t in terms])
        gain = np.concatenate([self.gain[self.starts[t]:self.starts[t + 1]] for t in terms])
        order = np.argsort(docs, kind="stable")
        docs, gain = docs[order], gain[order]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        return docs[first], np.add.reduceat(gain, first)

    def best(self, terms: np.ndarray, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents of the ``k`` highest scores, their scores, and how many blocks were read.

        Scores below ``least`` may be left out: they are beaten already.
        """
        sizes = self.starts[terms + 1] - self.starts[terms]
        terms = terms[np.argsort(sizes, kind="stable")]
        sizes = np.sort(sizes)
        short = int(np.searchsorted(np.cumsum(sizes), self.short, side="right"))
        iterators = []
        floor = max(1, least)
        some = [int(t) for t, n in zip(terms[:short], sizes) if n]
        if some:
            docs, scores = self._accumulated(some)
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            iterators.append((docs, scores, *self._by_block(docs, scores)))
        iterators += [self._list(int(t)) for t in terms[short:]]
        none = np.array([], dtype=np.int64)
        if not iterators:
            return none, none, 0
        bounds = np.stack([most for *_, most in iterators])
        total = bounds.sum(axis=0)
        found_docs, found_scores, blocks_read = none, none, 0
        for block in np.flatnonzero(total >= floor):
            if total[block] < floor:
                continue
            blocks_read += 1
            docs, scores = self._scored(iterators, bounds[:, block], block, floor)
            if not len(docs):
                continue
            found_docs = np.concatenate([found_docs, docs])
            found_scores = np.concatenate([found_scores, scores])
            if len(found_docs) > k:
                keep = np.lexsort((found_docs, -found_scores))[:k]
                found_docs, found_scores = found_docs[keep], found_scores[keep]
            if len(found_docs) == k:
                floor = max(floor, int(found_scores.min()))
        return found_docs, found_scores, blocks_read

    def _scored(self, iterators: list, bounds: np.ndarray, block: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a block whose score is at least ``floor``, and their scores."""
        low = self.edges[block]
        scores = np.zeros(self.doc_block, dtype=np.int64)
        order = np.argsort(-bounds, kind="stable")
        open_bound = int(bounds.sum())
        alive = None
        for i in order:
            if not bounds[i]:
                break
            docs, gain, begin, _ = iterators[i]
            own, gain = docs[begin[block]:begin[block + 1]] - low, gain[begin[block]:begin[block + 1]]
            if alive is None and open_bound < floor:  # no document outside the lists read so far can reach it
                alive = np.flatnonzero(scores)
            if alive is None:
                scores[own] += gain
            else:
                alive = alive[scores[alive] + open_bound >= floor]
                if not len(alive):
                    break
                at = np.minimum(np.searchsorted(own, alive), len(own) - 1)
                scores[alive] += np.where(own[at] == alive, gain[at], 0)
            open_bound -= int(bounds[i])
        if alive is None:
            alive = np.flatnonzero(scores)
        alive = alive[scores[alive] >= floor]
        return alive + low, scores[alive]


class _Best:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.array([], dtype=np.int64)] * items
        self.ids: list[list] = [[] for _ in range(items)]

    def least(self, item: int) -> int:
        return int(self.scores[item][-1]) if len(self.ids[item]) == self.k else 0

    def add(self, item: int, ids: list, scores: np.ndarray) -> None:
        ids, scores = self.ids[item] + ids, np.concatenate([self.scores[item], scores])
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i]))[:self.k]
        self.ids[item], self.scores[item] = [ids[i] for i in order], scores[order]


def _segments(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    """Runs of rows with about ``postings`` terms together."""
    held, size = [], 0
    for batch in batches:
        ends = batch.column("terms").offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + postings - size, side="right")) - 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop] - ends[start])
            start = stop
            if size >= postings or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _ranked_block(docs: DataFrame, items: list, k: int, segment_postings: int, id_col: str, text_col: str,
                  **options) -> DataFrame:
    """The best documents of some items ``(number, terms)`` in each task."""
    vocabulary: dict[bytes, int] = {}
    for _, terms in items:
        for term in terms:
            vocabulary.setdefault(term, len(vocabulary))
    counts = term_counts(docs, vocabulary, id_col, text_col)
    documents, all_terms = counts.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held.collect():  # at most one row for each term of the items
        weights[r.term] = term_weight(documents, r["count"])
    asked = [(number, np.array(sorted(i for i in {vocabulary[t] for t in terms} if weights[i] > 0), dtype=np.int64))
             for number, terms in items]
    shared = docs.sparkSession.sparkContext.broadcast((asked, weights, documents, all_terms))
    schema = StructType().add("number", "long").add(counts.schema["id"]).add("score", "long").add("part", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, documents, all_terms = shared.value
        best, id_type = _Best(len(asked), k), None
        for rows in _segments(batches, segment_postings):
            id_type = rows.schema.field("id").type
            segment = Segment(rows, weights, documents, all_terms, **options)
            for i, (_, terms) in enumerate(asked):
                found, scores, _ = segment.best(terms, k, best.least(i))
                if len(found):
                    best.add(i, segment.ids.take(pa.array(found)).to_pylist(), scores)
        if id_type is None:
            return
        part = TaskContext.get().partitionId()
        for i, (number, _) in enumerate(asked):
            many = len(best.ids[i])
            if many:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * many, pa.int64()), pa.array(best.ids[i], id_type), pa.array(best.scores[i], pa.int64()),
                     pa.array([part] * many, pa.int32())], names=schema.names)

    return counts.mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES,
           segment_postings: int = SEGMENT_POSTINGS, salts: int = SALTS, doc_block: int = DOC_BLOCK,
           short_share: float = SHORT_SHARE) -> DataFrame:
    """``item, rank, id, score``: the ``k`` best documents of every row of ``items``, all with a score above 0 if fewer."""
    asked = items.select(col(item_col).alias("item"), col(item_text_col).alias("text"))
    asked = saved(asked.withColumn("number", F.monotonically_increasing_id()), "search-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block)
        rows = [(r.number, terms_of(r.text)) for r in part.select("number", "text").collect()]
        one = _ranked_block(docs, rows, k, segment_postings, id_col, text_col, doc_block=doc_block,
                            short_share=short_share)
        found = one if found is None else found.unionByName(one)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    salted = Window.partitionBy("number", F.pmod("part", F.lit(salts))).orderBy(*order)
    whole = Window.partitionBy("number").orderBy(*order)
    top = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    top = top.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return top.join(asked.select("number", "item"), "number").select("item", "rank", "id", "score")

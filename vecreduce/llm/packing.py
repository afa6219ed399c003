"""Best-fit packing of token sequences by length-histogram planning.

``encoded`` turns each document into ids, ends it with an end mark and cuts only what is
longer than a sequence.  Each task numbers its pieces of each length, so a piece is known
by its task, its length and its number there.  ``placed`` then plans with counts alone:

1. count the pieces of each (task, length); a running sum over the tasks of a length turns
   a piece's number in its task into its rank within the length;
2. the histogram of lengths, at most ``capacity`` rows, is packed on the driver by best fit
   over counts, longest first: all pieces of a length go into the fullest sequences they
   still fit, a run of equal sequences in one step;
3. the plan's runs say which ranks of a length take which slots.  Pieces find theirs by
   binary search on (length, rank).

Memory: the plan has a few runs for each length, whatever the number of documents.  A
sequence holds at most ``capacity / 2`` different lengths' sum, so runs stay under
``capacity ** 1.5`` times a small factor.  The running sum of one length has a row a task.
A length that a third of all pieces share is spread over all tasks that made such pieces.
Encoding holds about a megabyte of text at a time, or one longer text, and the ids of words
it remembers, 200 MB.

The tokenizer lower-cases, drops white space and merges within words only, so a text's ids
are those of its words in a row.  Words recur, so each is encoded once while it is
remembered.  In texts of ASCII and Latin-1 letters alone, words are cut further by the
tokenizer's own pattern.

Defined cases: null and empty texts are the end mark alone, one id.  Rows that repeat an id
are documents of their own.  Documents without an id are packed too.  An empty table gives
no pieces and no sequences.  Very long texts are encoded whole and cut into full pieces,
the last of which may be shorter.  Extra columns, of any name, are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructType

from .common import Remembered, chunks, col, saved, tokenizer_file

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
_CHUNK_BYTES = 1 << 20
# The end of a word in this vocabulary, and its pattern for lower-cased ASCII and Latin-1 letters.
_WORD_END = "</w>"
_PLAIN_WORD = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
_SPACE = re.compile("[\t-\r ]+")


class Encoder:
    """Encodes texts word by word."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.lower_case = Tokenizer.from_str(json.dumps(json.loads(vocabulary) | {"normalizer": None}))
        for tokenizer in (self.tokenizer, self.lower_case):
            tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        ids = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(ids.values()) + 1, bool)
        self.ends_word[[i for token, i in ids.items() if token.endswith(_WORD_END)]] = True
        self.words = Remembered(self._encoded)
        self.plain_words = Remembered(self._plainly_encoded)

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _plainly_encoded(self, words: list[str]) -> list[bytes]:
        """The ids of words that the pattern cuts no further, encoded in a row and told apart by their last tokens."""
        ids = np.array(self.lower_case.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for _, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        words, plain = [], []
        for text in texts:
            plain.append(not text or not _NOT_PLAIN.search(text))
            words.append(_PLAIN_WORD.findall(text.lower()) if text and plain[-1] else _SPACE.split(text) if text else [])
        of = {True: self.plain_words.of([w for one, p in zip(words, plain) if p for w in one]),
              False: self.words.of([w for one, p in zip(words, plain) if not p for w in one])}
        return [b"".join(map(of[p], one)) for one, p in zip(words, plain)]


_ENCODERS: dict[bytes, Encoder] = {}  # of this worker


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
            end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """The pieces ``id, piece, start, length, tokens, part, number``, saved in the shared folder.

    ``tokens`` are the ids as little-endian unsigned 32-bit numbers.  ``part`` and
    ``number`` name the piece among those of its length.
    """
    if capacity < 1:
        raise ValueError(f"a sequence cannot hold {capacity} tokens")
    with open(vocabulary or tokenizer_file(VOCABULARY), "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    schema = StructType().add(given.schema["id"])
    for field in StructType.fromDDL("piece int, start long, length long, tokens binary, part int, number long"):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(shared.value)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[shared.value] = Encoder(shared.value)
        mark = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for rows in chunks(batch, 1, _CHUNK_BYTES):
                of, piece, start, length, tokens, number = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(rows.column(1).to_pylist())):
                    raw = ids + mark
                    many = len(raw) // 4
                    for k, a in enumerate(range(0, many, capacity)):
                        size = min(capacity, many - a)
                        of.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(size)
                        tokens.append(raw[4 * a:4 * (a + size)])
                        number.append(seen[size])
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary()),
                     pa.array([part] * len(of), pa.int32()), pa.array(number, pa.int64())], names=schema.names)

    return saved(given.mapInArrow(run, schema), "packing-pieces")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan for ``histogram``, a count for each length: runs ``(length, first rank,
    pieces, first sequence, pieces a sequence, offset)``.

    Longest pieces first, each into the sequence with the least room that still holds it,
    a new one if none does.  Sequences of equal room that stand in a row are one group, and
    a group takes as many pieces in one step as that rule would give it one by one.
    """
    plan = []
    rooms: list[int] = []  # in order
    groups: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, sequences)]
    opened = 0

    def put_back(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit a sequence of {capacity}")
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = room // length
            full = min(many, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - room))
                rank += full * each
                left -= full * each
                put_back(room - each * length, first, full)
            if full < many and left:  # fewer pieces than one more sequence takes
                plan.append((length, rank, left, first + full, left, capacity - room))
                put_back(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put_back(room, first + full, many - full)
    return plan


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, the places of their tokens.

    ``pieces`` are those of ``encoded``, with any columns beside ``part``, ``number`` and
    ``length``; the first two are dropped.  Sequences are numbered from 0.
    """
    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row a length
    plan = best_fit({r.length: r.n for r in histogram}, capacity)
    runs = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)
    ranked = (pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number"))
              .drop("base", "part", "number"))
    names = [c for c in ranked.columns if c != "rank"]
    schema = StructType([ranked.schema[c] for c in names])
    schema = schema.add("sequence_id", LongType()).add("offset", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks = shared.value[:, 0], shared.value[:, 1]
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(rank), dtype=np.int64)
            for one in np.unique(length):
                mine = length == one
                own = ranks[starts[one]:starts[one + 1]]
                at[mine] = starts[one] + np.searchsorted(own, rank[mine], side="right") - 1
            _, first_rank, _, first, each, offset = shared.value[at].T
            turn = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(first + turn // each), pa.array(offset + turn % each * length)], names=schema.names)

    return ranked.select(*names, "rank").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, tokens`` of placed pieces: each sequence's ids, as they are trained on.

    A sequence collects at most ``capacity`` pieces, and its tokens are of bounded size.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "tokens")))
    return pieces.groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p.tokens)), "")).alias("tokens"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """``id, piece, start, length, tokens, sequence_id, offset`` of every piece of every row."""
    found = placed(encoded(docs, id_col, text_col, capacity, end_id, vocabulary), capacity)
    return found.select("id", "piece", "start", "length", "tokens", "sequence_id", "offset")

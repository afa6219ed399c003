"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE, B a sentence-piece BPE that puts a space before a text, so
A encodes the text with a space before it.  Each token has its bytes, and the running sums
of their lengths give its byte range.  Per batch, ``pandas.merge_asof`` keyed by text
gives each token start the other side's token that covers it.  The union of both
directions is the overlaps: of two overlapping tokens the later start lies in the other.
Byte offsets at which tokens of both sides end cut a text into groups.

``aligned`` does this for each document on its own.  ``with_pair_counts`` counts every id
pair over the corpus and brings the counts back.  A few pairs are in almost all documents
and most are in a few, so the table of pairs is split by a count.  The ``heavy_pairs`` most
frequent, of bounded size, are sent to all tasks and looked up there.  Links of the other
pairs are joined by shuffle, where no pair has more rows than the least frequent heavy one.

Neither tokenizer merges over a space that follows a character other than white space and
precedes one, so both encode the parts of a text between such spaces on their own, and
tokens of both sides end where a part ends.  A text's groups are those of its parts in a row
and its links those of them all.  Parts recur, so each is encoded and aligned once while it
is remembered.  New parts are encoded some together, told apart by their tokens' bytes, and
aligned in one batch.

Memory: a batch is aligned about half a megabyte of text at a time, or one longer text; the
alignments of parts remembered are 200 MB.

Defined cases: null and empty texts, and texts whose tokens' joined bytes differ from a
space and the text, have no tokens, groups or links.  Rows that repeat an id, and rows
without one, are documents of their own, and each counts.  Ties for the highest count of a
B id all count as best.  An empty table gives an empty result.  Very long texts are encoded
and aligned whole.  Extra columns, of any name, are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import Remembered, chunks, col, saved, tokenizer_file

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
HEAVY_PAIRS = 1_000_000
_CHUNK_BYTES = 1 << 19
#: New parts encoded together; the encoders take longer for a part alone and in a long row.
_TOGETHER = 64
_COLUMNS = ("n_a long, n_b long, n_groups long, n_links long, groups string, "
            "links array<struct<a: int, b: int, n: int>>")
_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
#: What stands behind a token's id in the text of groups: another of its side, the other side, the next group, the end.
_MARKS = (",", "|", ";", "\n")
#: What stands before the id pairs in a part's alignment: how many tokens of A, of B, and groups it has.
_COUNTS = 3
#: The ids of some texts laid end to end, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]
#: Of one text: ``_COUNTS`` numbers and the id pairs of its links, as 64-bit integers, and the text of its groups.
Alignment = tuple[bytes, str]


def byte_characters() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are written.

    Printable characters of Latin-1 stand for themselves, the other bytes in order for the
    characters from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_vocabulary: bytes, piece_vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_vocabulary.decode())
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_vocabulary)
        of = byte_characters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_sizes = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.written = [f"{i}{mark}" for i in ids for mark in _MARKS]

        self.parts = Remembered(self._aligned, overhead=250, value_bytes=lambda v: len(v[0]) + len(v[1]))

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides of each text, with a space before it."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(texts, num_threads=1) if texts else []

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the ids' bytes are a space and the text, on both sides."""
        raw = b" " + text.encode()
        return (b"".join(map(self.a_bytes.__getitem__, a)) == raw
                and b"".join(map(self.b_bytes.__getitem__, b)) == raw)

    def _joined(self, parts: list[str]) -> tuple[Ids, Ids] | None:
        """The ids of parts without white space at their ends; none if a token crosses two of them."""
        raw = b" " + " ".join(parts).encode()
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        rows = self._both([" ".join(parts[i:i + _TOGETHER]) for i in range(0, len(parts), _TOGETHER)])
        found = []
        for ids, sizes, pieces in zip(rows, (self.a_sizes, self.b_sizes), (self.a_bytes, self.b_bytes)):
            ids = list(chain.from_iterable(ids))
            flat = np.array(ids, np.int64)
            token_ends = np.cumsum(sizes[flat])
            if b"".join(map(pieces.__getitem__, ids)) != raw:
                return None
            at = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[at], ends):
                return None
            found.append((flat, np.diff(at + 1, prepend=0)))
        return tuple(found)

    def _aligned(self, parts: list[str]) -> list[Alignment]:
        """Each part's alignment, one without tokens where its bytes are not a space and the part."""
        plain = [p for p in parts if p and not (p[0].isspace() or p[-1].isspace() or "▁" in p)]
        joined = self._joined(plain) if plain else None
        found = dict(zip(plain, alignments(self, *joined))) if joined else {}
        others = [p for p in parts if p not in found]
        if others:
            found.update(zip(others, alignments(self, *map(laid, zip(*[
                (a, b) if self._same(p, a, b) else ([], []) for p, a, b in zip(others, *self._both(others))])))))
        return [found[p] for p in parts]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides of each text, none where the bytes differ from a space and the text."""
        found = []
        for text in texts:
            parts = parts_of(text) if text else []
            a, b = (list(chain.from_iterable(ids)) for ids in self._both(parts))
            if not parts or not self._same(text, a, b):
                a = b = []
            found.append((np.array(a, np.int64), np.array(b, np.int64)))
        return found


def laid(ids: list) -> Ids:
    return (np.concatenate([np.array([], np.int64), *(np.asarray(x, np.int64) for x in ids)]),
            np.array(list(map(len, ids)), np.int64))


_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def parts_of(text: str) -> list[str]:
    """``text`` cut at the spaces between two other characters; other white space stays inside a part."""
    parts = text.split(" ")
    if parts[0] and not _ODD_SPACE.search(text):
        return parts
    whole = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace() and whole[-1] and not whole[-1][-1].isspace():
            whole.append(part)
        else:
            whole[-1] += " " + part
    return whole


def texts_parts(texts: pa.StringArray) -> pa.ListArray:
    """``parts_of`` each text; null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = [i for i, t in enumerate(texts.to_pylist()) if not t or t[0] == " " or _ODD_SPACE.search(t)]
    parts = pc.split_pattern(texts, " ")
    if not odd:
        return parts
    place = np.arange(len(texts))
    place[odd] = len(texts) + np.arange(len(odd))
    others = [parts_of(t) if t else [] for t in texts.take(odd).to_pylist()]
    return pa.concat_arrays([parts, pa.array(others, parts.type)]).take(pa.array(place))


def _frame(ids: Ids, sizes: np.ndarray, name: str) -> pd.DataFrame:
    """The tokens of some texts laid end to end: their ``doc``, byte range and place."""
    flat, many = ids
    ends = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(many)), many), "start": ends - sizes[flat],
                         "end": ends, name: np.arange(len(flat)), "token": flat})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The places of all overlapping pairs of tokens, each once."""
    to_b = pd.merge_asof(a[["doc", "start", "a"]], b[["doc", "start", "b"]], on="start", by="doc")
    to_a = pd.merge_asof(b[["doc", "start", "b"]], a[["doc", "start", "a"]], on="start", by="doc")
    covering = to_a["a"].to_numpy()
    later = b["start"].to_numpy() > a["start"].to_numpy()[covering]  # equal starts are in the first direction
    return (np.concatenate([to_b["a"].to_numpy(), covering[later]]),
            np.concatenate([to_b["b"].to_numpy(), to_a["b"].to_numpy()[later]]))


def _groups(a: pd.DataFrame, b: pd.DataFrame, written: list[str]) -> tuple[np.ndarray, list[str]]:
    """The ``doc`` of every group, and the text of groups of each text that has any."""
    a_ends, b_ends = a["end"].to_numpy(), b["end"].to_numpy()
    ended = np.zeros((2, a_ends[-1] + 1), bool)
    ended[0, a_ends] = ended[1, b_ends] = True
    both = ended[0] & ended[1]
    before = np.cumsum(both) - both  # groups that end earlier
    group = np.concatenate([before[a_ends], before[b_ends]])
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    order = np.argsort(2 * group + side, kind="stable")
    group, side = group[order], side[order]
    doc = np.concatenate([a["doc"].to_numpy(), b["doc"].to_numpy()])[order]
    token = np.concatenate([a["token"].to_numpy(), b["token"].to_numpy()])[order]
    mark = np.full(len(order), 3)
    same = group[1:] == group[:-1]
    mark[:-1] = np.where(doc[1:] != doc[:-1], 3, np.where(~same, 2, np.where(side[1:] != side[:-1], 1, 0)))
    of_group = a["doc"].to_numpy()[both[a_ends]]
    strings = "".join(map(written.__getitem__, (len(_MARKS) * token + mark).tolist()))
    return of_group, strings.split(_MARKS[3])[:-1]


def alignments(tokenizers: Tokenizers, a_ids: Ids, b_ids: Ids) -> list[Alignment]:
    """The alignment of some texts that have tokens on both sides or none at all."""
    (a_flat, n_a), (b_flat, n_b) = a_ids, b_ids
    size = len(n_a)
    out = np.zeros((size, _COUNTS), np.int64)
    out[:, 0], out[:, 1] = n_a, n_b
    if not len(a_flat):
        return [(row.tobytes(), "") for row in out]
    a, b = _frame(a_ids, tokenizers.a_sizes, "a"), _frame(b_ids, tokenizers.b_sizes, "b")
    at_a, at_b = overlaps(a, b)
    doc = a["doc"].to_numpy()[at_a]
    order = np.argsort(doc, kind="stable")
    of_group, found = _groups(a, b, tokenizers.written)
    out[:, 2] = np.bincount(of_group, minlength=size)
    links = np.bincount(doc, minlength=size)
    ends = np.cumsum(_COUNTS + links)
    starts = ends - links - _COUNTS
    numbers = np.empty(ends[-1], np.int64)
    pairs = np.ones(len(numbers), bool)
    for k in range(_COUNTS):
        numbers[starts + k] = out[:, k]
        pairs[starts + k] = False
    numbers[pairs] = (a_flat[at_a] * len(tokenizers.b_bytes) + b_flat[at_b])[order]
    raw, texts = numbers.tobytes(), [""] * size
    for i, text in zip(np.flatnonzero(n_a).tolist(), found):
        texts[i] = text
    return [(raw[x:y], text) for x, y, text in zip((8 * starts).tolist(), (8 * ends).tolist(), texts)]


def numbers_of(values: list[Alignment]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all alignments in a row, and where each begins."""
    lengths = np.array([len(v[0]) // 8 for v in values], np.int64)
    return np.frombuffer(b"".join([v[0] for v in values]), np.int64), np.cumsum(lengths) - lengths


def align(tokenizers: Tokenizers, texts: pa.StringArray) -> pa.RecordBatch:
    """The columns of ``aligned`` but the id for some texts."""
    size, wide = len(texts), len(tokenizers.b_bytes)
    lists = texts_parts(texts)
    doc = np.repeat(np.arange(size), lists.value_lengths().to_numpy())
    parts = lists.flatten().dictionary_encode()
    part = parts.indices.to_numpy()
    distinct = parts.dictionary.to_pylist()
    values = list(map(tokenizers.parts.of(distinct), distinct))
    numbers, at = numbers_of(values)
    without = numbers[at] == 0
    if without.any():  # these texts are parts of their own
        others = np.unique(doc[without[part]])
        values += alignments(tokenizers, *map(laid, zip(*tokenizers.encode(texts.take(pa.array(others)).to_pylist()))))
        kept = ~np.isin(doc, others)
        doc = np.concatenate([doc[kept], others])
        order = np.argsort(doc, kind="stable")
        doc, part = doc[order], np.concatenate([part[kept], len(distinct) + np.arange(len(others))])[order]
        numbers, at = numbers_of(values)
    bounds = np.searchsorted(doc, np.arange(size + 1))
    linked = np.diff(np.append(at, len(numbers))) - _COUNTS

    def sums(of_part: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of_part[part])])[bounds])

    links = linked[part]
    ends = np.cumsum(links)
    place = np.arange(links.sum()) + np.repeat(at[part] + _COUNTS - ends + links, links)
    pairs = np.int64(len(tokenizers.a_bytes) * wide)
    keys = np.sort(np.repeat(doc, links) * pairs + numbers[place])
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys)))
    doc_of, pair = np.divmod(keys[first], pairs)
    distinct_links = pa.StructArray.from_arrays(
        [pa.array(v.astype(np.int32)) for v in (pair // wide, pair % wide, times)], fields=list(_LINK))
    groups = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                      pa.array([v[1] for v in values], pa.string()).take(pa.array(part)))
    return pa.RecordBatch.from_arrays(
        [*(pa.array(sums(numbers[at + k])) for k in range(_COUNTS)), pa.array(sums(linked)),
         pc.binary_join(groups, _MARKS[2]),
         pa.ListArray.from_arrays(pa.array(np.searchsorted(doc_of, np.arange(size + 1)).astype(np.int32)), distinct_links)],
        names=["n_a", "n_b", "n_groups", "n_links", "groups", "links"])


_TOKENIZERS: dict[tuple[bytes, bytes], Tokenizers] = {}  # of this worker


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_vocabulary: str | None = None,
            piece_vocabulary: str | None = None) -> DataFrame:
    """``row, id, n_a, n_b, n_groups, n_links, groups, links`` of every row.

    ``row`` numbers the rows of a run.  ``groups`` is ``a1,a2|b1;a3|b2,b3``: each group's A
    ids and B ids in order.  ``links`` are the document's distinct id pairs with ``n``, how
    many of its links hold them.
    """
    read = []
    for path in (byte_vocabulary or tokenizer_file(BYTE_VOCABULARY), piece_vocabulary or tokenizer_file(PIECE_VOCABULARY)):
        with open(path, "rb") as file:
            read.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(read))
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    schema = StructType.fromDDL("row long").add(given.schema["id"])
    for field in StructType.fromDDL(_COLUMNS):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _TOKENIZERS.get(shared.value)
        if tokenizers is None:
            _TOKENIZERS.clear()
            tokenizers = _TOKENIZERS[shared.value] = Tokenizers(*shared.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in chunks(batch, 1, _CHUNK_BYTES):
                found = align(tokenizers, rows.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + rows.num_rows)), rows.column(0), *found.columns],
                    names=schema.names)
                row += rows.num_rows

    return given.mapInArrow(run, schema)


def pair_table(alignments: DataFrame) -> DataFrame:
    """``a, b, links, best`` of every id pair that is linked anywhere.

    ``links`` is how many links of the corpus hold the pair; ``best``, whether that is the
    most of its B id.  A B id has at most as many pairs as A has ids.
    """
    pairs = (alignments.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("links")))
    most = F.max("links").over(Window.partitionBy("b"))
    return saved(pairs.withColumn("best", F.col("links") == most), "alignment-pairs")


def _least_heavy(pairs: DataFrame, heavy_pairs: int) -> int:
    """The least power of two such that at most ``heavy_pairs`` pairs have as many links."""
    sizes = pairs.groupBy(F.floor(F.log2("links")).alias("power")).count().collect()  # at most 63 rows
    held, least = 0, (1 << 63) - 1
    for r in sorted(sizes, reverse=True):
        held += r["count"]
        if held > heavy_pairs:
            break
        least = 1 << r.power
    else:
        least = 1
    return least


def with_pair_counts(alignments: DataFrame, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """``alignments`` (a saved table) without ``row`` and ``links``, with ``n_best`` and ``count_sum``.

    ``n_best``: links whose pair is the most frequent of its B id, ties included;
    ``count_sum``: the sum of all links' pair counts.
    """
    pairs = pair_table(alignments)
    least = _least_heavy(pairs, heavy_pairs)
    heavy = pairs.where(F.col("links") >= least).toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    keys = (heavy["a"].to_numpy().astype(np.int64) << 32) | heavy["b"].to_numpy()
    shared = alignments.sparkSession.sparkContext.broadcast(
        (keys, heavy["links"].to_numpy().astype(np.int64), heavy["best"].to_numpy(zero_copy_only=False)))
    names = [c for c in alignments.columns if c not in ("row", "links")]
    schema = StructType([alignments.schema[c] for c in names + ["row"]])
    for field in StructType.fromDDL("n_best long, count_sum long, rest array<struct<a: int, b: int, n: int>>"):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                links = batch.column("links")
                sizes = np.diff(links.offsets.to_numpy())
                flat = links.flatten()
                a, b, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
                distinct, place = np.unique((a << 32) | b, return_inverse=True)
                at = np.searchsorted(keys, distinct)
                known = np.zeros(len(distinct), bool)
                inside = at < len(keys)
                known[inside] = keys[at[inside]] == distinct[inside]
                of = np.where(known, at, 0)
                weight = np.where(known, counts[of], 0)[place] * n if len(keys) else 0 * n
                hits = np.where(known & best[of], 1, 0)[place] * n if len(keys) else 0 * n
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                total, top = (np.concatenate([[0], np.cumsum(v)]) for v in (weight, hits))
                unknown = ~known[place]
                offsets = np.concatenate([[0], np.cumsum(unknown)])[bounds].astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(v[unknown].astype(np.int32)) for v in (a, b, n)],
                                                  fields=list(_LINK))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in names] + [
                        batch.column("row"), pa.array(np.diff(top[bounds])), pa.array(np.diff(total[bounds])),
                        pa.ListArray.from_arrays(pa.array(offsets), rest)], names=schema.names)

    found = alignments.mapInArrow(run, schema)
    if least > 1:  # the rarer pairs
        found = saved(found, "alignment-heavy")
        light = (found.select("row", F.inline("rest")).join(pairs.where(F.col("links") < least), ["a", "b"])
                 .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"),
                                     F.sum(F.col("n") * F.col("links")).alias("more_sum")))
        found = found.join(light, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return found.select(*names, "n_best", "count_sum")

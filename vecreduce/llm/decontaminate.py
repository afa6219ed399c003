"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every benchmark item.  A document's words are
streamed through it while the length of the longest match that ends at each word is
tracked.  Wherever that length reaches the window (or a whole item shorter than the
window ends), the words of the match are hit.  Hit words join to spans, and
``remove_spans`` cuts them out of the text, or the whole document where they cover too
much of it.

The benchmark's size is measured first, and its items are taken in blocks of about
``block_bytes`` of text; longer items are cut into parts that share ``window - 1`` words, so
that every window lies in one part.  Each block's automaton is built, sent to the executors
and run over all documents.  With one block nothing is shuffled.  With several, a pass saves
what its block hits in each distinct text, by the text's SHA-256: no text is written between
passes.  The last pass reads this back by digest and a salt of the document's id, in a join
that moves the texts once where the hits are too many for Spark to broadcast.

States know their window and the short items that end with them, so texts and items of one
repeated word take time in proportion to their length.

Defined cases: null and wordless texts have no words and no hits.  Items without words
match nothing.  Items with a null id hit words but are not listed.  Items that share an id
are one item.  An empty benchmark hits nothing.  Repeated documents are judged alike.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import col, salt_of, saved

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_BYTES = 1_000_000
SALTS = 16
_PARTS = 64  # a part of an item has a block's bytes over this in words, about a tenth of a block

#: Words are runs of digits, letters and all non-ASCII characters; A-Z are lower-cased.
_WORD_BYTE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTE).split() if text else []


class SuffixAutomaton:
    """All runs of words of a set of items, with the items of each window.

    ``step[v]`` maps a word to the next state, ``link[v]`` is the state of the longest
    shorter suffix that occurs in more places, ``longest[v]`` the length of v's longest run.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.longest = [-1], [0]
        ends = []  # (state of a prefix of an item, item, whether it is a whole short item)
        shortest = window
        for item, words in items:
            v, short = 0, len(words) < window
            for i, word in enumerate(words, 1):
                v = self._extended(v, word)
                if i >= window or (short and i == len(words)):
                    ends.append((v, item, short))
            if words:
                shortest = min(shortest, len(words))
        self.shortest = shortest
        #: The state of each state's last ``window`` words, and the nearest that ends a whole short item; 0 is none.
        self.window_state, self.short_state = [0] * len(self.step), [0] * len(self.step)
        short_ends = {v for v, _, short in ends if short}
        for v in sorted(range(1, len(self.step)), key=self.longest.__getitem__):  # links lead to shorter ones
            up = self.link[v]
            if self.longest[v] >= window:
                self.window_state[v] = self.window_state[up] or v
            self.short_state[v] = v if v in short_ends else self.short_state[up]
        self.items_of_window: dict[int, set[str]] = {}
        self.short_items: dict[int, set[str]] = {}
        for v, item, short in ends:
            if short:
                self.short_items.setdefault(v, set()).update([] if item is None else [item])
            else:
                self.items_of_window.setdefault(self.window_state[v], set()).update([] if item is None else [item])

    def _state(self, longest: int, link: int, step: dict[bytes, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.step.append(step)
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of p's longest run with ``word`` added, taken out of ``q`` if that holds longer runs."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        copy = self._state(self.longest[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, word: bytes) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return self._split(last, q, word)
        new = self._state(self.longest[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.step[p][word], word)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit spans ``[first, last)`` of a document's words, in order, and the items that hit them."""
        step, link, longest, shortest, window = self.step, self.link, self.longest, self.shortest, self.window
        short_items, window_state, short_state = self.short_items, self.window_state, self.short_state
        spans: list[tuple[int, int]] = []
        states, items, ended = set(), set(), set()
        v = length = 0
        for i, word in enumerate(words, 1):
            t = step[v].get(word)
            while t is None and v:
                v = link[v]
                length = longest[v]
                t = step[v].get(word)
            if t is None:
                continue  # at the root, with length 0
            v = t
            length += 1
            if length < shortest:
                continue
            found = 0
            if length >= window:
                found = window
                states.add(window_state[v])
            if short_items:
                u = short_state[v]
                if u and length < longest[u]:  # of this state a longer run than the match is an item
                    u = short_state[link[u]]
                if u:
                    found = max(found, longest[u])
                    ended.add(u)
            if found:
                first = i - found
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))
        for state in states:
            items |= self.items_of_window[state]
        for u in ended:  # and the shorter items that end with it, of fewer words each
            while u:
                items |= short_items[u]
                u = short_state[link[u]]
        return spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(a + b):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _item_parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> DataFrame:
    """``item, part, text``: the items' words; of more than ``most`` windows, in parts of as many."""
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                starts = range(0, max(1, len(words) - window + 1), most) if words else ()
                for part, at in enumerate(starts):
                    run_of = b" ".join(words[at:at + most + window - 1]).decode()
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item.as_py()], pa.string()),
                                                      "part": pa.array([part], pa.int32()), "text": [run_of]})

    return items.mapInArrow(run, "item string, part int, text string")


def _automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """``(automaton, whether it is the last)`` of the benchmark's blocks, one at a time."""
    size = benchmark.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(text_col).alias("text"))
    if blocks > 1:
        items = saved(_item_parts(benchmark, item_col, text_col, window, max(window, block_bytes // _PARTS)),
                      "decontaminate-items")
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "part", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield SuffixAutomaton([(r.item, words_of(r.text)) for r in part.collect()], window), b + 1 == blocks


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_FOUND = "n_words long, n_hit long, spans array<struct<first: int, last: int>>, items array<string>"


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from each span's first word to its last one."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at:places[first][0]])
        at = places[last - 1][1]
    return "".join(kept) + text[at:]


def _with_cut_texts(rows: pa.StructArray, text_at: int, length_at: int | None, spans: list) -> pa.StructArray:
    """``rows`` with each text's spans cut out, and its length renewed where it changed."""
    if not any(spans):
        return rows
    fields = list(rows.type)
    columns = rows.flatten()
    texts = columns[text_at].to_pylist()
    lengths = None if length_at is None else columns[length_at].to_pylist()
    for i, found in enumerate(spans):
        if found:
            texts[i] = without_spans(texts[i], found)
            if lengths is not None:
                lengths[i] = len(texts[i])
    columns[text_at] = pa.array(texts, fields[text_at].type)
    if lengths is not None:
        columns[length_at] = pa.array(lengths, fields[length_at].type)
    return pa.StructArray.from_arrays(columns, fields=fields)


def _pass(found: DataFrame, automaton, text_col: str, cut: bool, length_col: str | None) -> DataFrame:
    """The last block's automaton over all rows: what it finds is joined to what is known of the others."""
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(5)
            text_at = rows.type.get_field_index(text_col)
            counts, hits, spans, items = [], [], [], []
            for text, known, named in zip(rows.field(text_at), batch.column(3), batch.column(4)):
                words = words_of(text.as_py())
                new, ids = automaton.value.matches(words)
                if len(known):
                    new = _merged(new, [(s["first"], s["last"]) for s in known.as_py()])
                    ids = ids.union(named.as_py())
                counts.append(len(words))
                hits.append(sum(last - first for first, last in new))
                spans.append(new)
                items.append(sorted(ids))
            if cut:
                length_at = None if length_col is None else rows.type.get_field_index(length_col)
                rows = _with_cut_texts(rows, text_at, length_at, spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                 pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], _SPANS),
                 pa.array(items, pa.list_(pa.string())), rows], names=names)

    return found.mapInArrow(run, found.schema)


def _hits(docs: DataFrame, automaton, text_col: str) -> DataFrame:
    """``digest, spans, items`` of the distinct texts that one block's automaton hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, spans, items = [], [], []
            for text in batch.column(0).to_pylist():
                new, ids = automaton.value.matches(words_of(text))
                if new:
                    digests.append(hashlib.sha256(text.encode()).hexdigest())
                    spans.append([{"first": a, "last": b} for a, b in new])
                    items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=["digest", "spans", "items"])

    found = docs.select(col(text_col).alias("text")).where("text is not null").mapInArrow(
        run, "digest string, spans array<struct<first: int, last: int>>, items array<string>")
    return found.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))  # all equal


def _with_known(found: DataFrame, hits: list[DataFrame], digest) -> DataFrame:
    """``found`` with the spans and items of earlier blocks, by the digest of a row's text and a salt of its id."""
    known = hits[0]
    for more in hits[1:]:
        known = known.unionByName(more)
    known = (known.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("known_spans"),
                                         F.flatten(F.collect_list("items")).alias("known_items"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    rows = found.withColumns({"digest": digest, "salt": salt_of(F.col("id"), SALTS)})
    return rows.join(known, ["digest", "salt"], "left").select(
        "id", "n_words", "n_hit", F.coalesce("known_spans", "spans").alias("spans"),
        F.coalesce("known_items", "items").alias("items"), "row")


def _found(docs: DataFrame, row, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
           item_text_col: str, window: int, block_bytes: int, cut: bool = False,
           length_col: str | None = None) -> DataFrame:
    empty = StructType.fromDDL(_FOUND)
    found = docs.select(col(id_col).alias("id"),
                        *[(F.array() if f.dataType.typeName() == "array" else F.lit(0)).cast(f.dataType).alias(f.name)
                          for f in empty], row.alias("row"))
    hits = []
    for automaton, last in _automata(benchmark, item_col, item_text_col, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        if not last:
            hits.append(saved(_hits(docs, shared, text_col), "decontaminate-hits"))
            shared.destroy()
    if hits:
        found = _with_known(found, hits, F.sha2(F.col("row").getField(text_col).cast("binary"), 256))
    return _pass(found, shared, text_col, cut, length_col)


def matched(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, n_words, n_hit, spans, items`` of every row.

    ``spans`` are the hit spans in words, end exclusive; ``items`` the ids whose windows
    occur, as strings in string order.
    """
    return _found(docs, F.struct(col(text_col)), benchmark, id_col, text_col, item_col, item_text_col,
                  window, block_bytes).drop("row")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 block_bytes: int = BLOCK_BYTES, max_coverage: float = MAX_COVERAGE,
                 length_col: str | None = None) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts.

    A span is cut when its match is as long as the window, or a whole shorter item.
    Documents whose hit words are more than ``max_coverage`` of all their words go
    entirely.  ``length_col``, if given, becomes the changed text's length.  Documents
    without hits are returned as they are.
    """
    found = _found(docs, F.struct(*[col(c) for c in docs.columns]), benchmark, id_col, text_col, item_col,
                   item_text_col, window, block_bytes, True, length_col)
    return found.where(F.col("n_hit") <= max_coverage * F.col("n_words")).select("row.*")

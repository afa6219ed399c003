"""Token counts of fields and sections by offset-mapped attribution.

A document is its fields in order, each but the last followed by a line end, and is
encoded once as a whole.  The vocabulary is a byte-level BPE, so the tokens' byte lengths
add up to the document and their running sums give each token's character span.  Token
spans are joined by interval with the sections, which cover the document without gaps: a
line with its line end, or a whole field.  A token that crosses a boundary belongs to one
section by the ``rule``:

    start   the section of its first character
    end     the section of its last character
    most    the section with most of its characters, the earlier one of equal shares

So the sections' counts always add up to the document's.  Documents never meet: nothing
is shuffled.  The vocabulary is a file of bounded size that the driver reads and sends out.

Defined cases: null fields count as empty.  An empty document has no tokens and one empty
section for each field.  Repeated rows give repeated results.  Very long texts are encoded
whole, also those of white space only.  An empty table gives an empty result; extra
columns, of any name, are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's encoder cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters that the pattern's \s stands for.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{10000,}}")
RULES = ("start", "end", "most")
_SECTIONS = pa.list_(pa.struct([("field", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                                ("tokens", pa.int64())]))


class Encoder:
    """Encodes texts to token spans."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, vocabulary.splitlines())}
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.runs = None
        if pattern == PATTERN:
            self.runs = tiktoken.Encoding("runs", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """The ids of a text.

        The encoder's matcher recurses over white space and fails on very long runs.  By the
        pattern such a run is one piece but for its last character, which goes with what
        follows it; so it is merged on its own, and the text is encoded from there on.
        """
        found, at = [], 0
        for run in _LONG_RUN.finditer(text) if self.runs else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            found += self.encoding.encode_ordinary(text[at:run.start()])
            found += self.runs.encode_ordinary(text[run.start():end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first and last character of each token; tokens that share a character both have it."""
        ids = np.array(self.ids(text), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if len(raw) == len(text):
            return starts, ends - 1
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char_of[starts], char_of[ends - 1]


def sections_of(values: list[str | None], by_line: bool) -> tuple[str, np.ndarray, np.ndarray]:
    """The document of some fields, the starts of its sections and each section's field."""
    parts = [v or "" for v in values]
    text = "\n".join(parts)
    starts, fields, at = [], [], 0
    for number, part in enumerate(parts):
        starts.append(at)
        fields.append(number)
        if by_line:
            end = part.find("\n")
            while 0 <= end < len(part) - 1:
                starts.append(at + end + 1)
                fields.append(number)
                end = part.find("\n", end + 1)
        at += len(part) + 1
    return text, np.array(starts, dtype=np.int64), np.array(fields, dtype=np.int32)


def attributed(first: np.ndarray, last: np.ndarray, starts: np.ndarray, size: int, rule: str) -> np.ndarray:
    """How many tokens each section has; ``first`` and ``last`` are the tokens' characters."""
    of_first = np.searchsorted(starts, first, side="right") - 1
    if rule == "start":
        owner = of_first
    else:
        of_last = np.searchsorted(starts, last, side="right") - 1
        owner = of_last
        if rule == "most":
            bounds = np.append(starts, size)
            for t in np.flatnonzero(of_first != of_last):
                over = np.arange(of_first[t], of_last[t] + 1)
                shared = np.minimum(bounds[over + 1], last[t] + 1) - np.maximum(bounds[over], first[t])
                owner[t] = over[shared.argmax()]
    return np.bincount(owner, minlength=len(starts))


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}  # of this worker


def counted(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), by_line: bool = True,
            rule: str = "most", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id, n_tokens, sections`` of every row.

    A section has the number of its field, its characters ``start`` to ``end`` (exclusive)
    in the joined document, and its ``tokens``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    given = docs.select(col(id_col).alias("id"), *[col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    schema = StructType().add(given.schema["id"])
    for field in StructType.fromDDL("n_tokens long, sections array<struct<field: int, start: long, end: long, "
                                    "tokens: long>>"):
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (shared.value, pattern)
        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(*key)
        for batch in batches:
            totals, parts, bounds = [], [], [0]
            for i in range(batch.num_rows):
                text, starts, numbers = sections_of([c[i].as_py() for c in batch.columns[1:]], by_line)
                counts = attributed(*encoder.spans(text), starts, len(text), rule)
                ends = np.append(starts[1:], len(text))
                totals.append(int(counts.sum()))
                parts.append((numbers, starts, ends, counts))
                bounds.append(bounds[-1] + len(starts))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 4
            sections = pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SECTIONS.value_type)], fields=list(_SECTIONS.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), sections)], names=schema.names)

    return given.mapInArrow(run, schema)

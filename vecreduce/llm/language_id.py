"""Language identification by segmentation-marginalised unigrams.

A text's words are its runs of letters, lower-cased, each with the vocabulary's word mark
in front.  Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces, which the
forward algorithm adds up.  A letter outside the vocabulary is a small fixed probability
times those of the vocabulary's byte pieces that spell it, which every language has of its
own; where no language saw such letters they tell nothing.  A text's log probability is the sum over its words, and its
score the posterior of the best language under equal priors.

The piece probabilities are learned by expectation maximisation.  Spark counts the words of
at most about ``fit_rows`` labelled rows of each language; each round sums expected piece
counts over all segmentations of those words.  What comes to the driver is one number for
each piece and language of a block of ``LANGUAGES``; further blocks are fitted in turn and
live in broadcast files.

Scoring reads every whole text once and shuffles nothing; with more than one block of
languages, once for each, and the documents are saved between.  A worker remembers words
up to ``REMEMBERED`` and ``REMEMBERED_CELLS`` numbers.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is
everything when there is no labelled row to learn from.  Of languages equally likely the
first in string order is taken.  Rows without a language are not learned from.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import col, saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FIT_ROWS = 1_000
ROUNDS = 3
SMOOTHING = 0.01
BYTE_SMOOTHING = 1.0
UNKNOWN = 1e-7
LANGUAGES = 128
REMEMBERED = 400_000
REMEMBERED_CELLS = 16_000_000
BYTES = 256
UNDETERMINED = "und"
_MARK = "▁"
_RUN = re.compile(r"[^\W\d_]+")
_CELLS = 1 << 18
_SMALL = 1e-100


def words_of(text: str | None) -> list[str]:
    return _RUN.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def read_pieces(path: str) -> list[str]:
    """The vocabulary's pieces that words can be made of: letters, with or without the mark."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p == _MARK or _RUN.fullmatch(p.removeprefix(_MARK))})


class Lattice:
    """The segmentations of words into pieces.  After the pieces' ids come those of the byte pieces, then
    ``none``, then the letters without a piece that the words at hand have.

    Pieces are looked up in a trie whose edges are a sorted array, for all positions of
    many words at once; a position is followed only as long as some piece goes on.
    """

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.byte, self.none = len(pieces), len(pieces) + BYTES
        self.single = np.array(sorted(ord(p) for p in pieces if len(p) == 1), dtype="<u4")
        self.widest = max(map(len, pieces), default=1)
        self.alphabet = np.array(sorted({_MARK, *"".join(pieces)}, key=ord), dtype="<U1").view("<u4")
        symbol = {chr(c): i for i, c in enumerate(self.alphabet.tolist(), 1)}
        self.symbols = len(symbol) + 1  # 0 is any character that no piece has
        nodes = {"": 0}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes))
        edges = sorted((nodes[n[:-1]] * self.symbols + symbol[n[-1]], i) for n, i in nodes.items() if n)
        self.edges = np.array([e for e, _ in edges] or [-1], dtype=np.int64)
        self.targets = np.array([t for _, t in edges] or [0], dtype=np.int64)
        self.piece_at = np.array([self.ids.get(n, self.none) for n in nodes], dtype=np.int32)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(_MARK + w for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def spelled(self, words: list[str]) -> np.ndarray:
        """The distinct letters of the words, and the mark, that have no piece, as sorted code points."""
        return np.setdiff1d(self._codes(words), self.single)

    @staticmethod
    def bytes_of(letters: np.ndarray) -> list[np.ndarray]:
        return [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), dtype=np.uint8) for c in letters.tolist()]

    def with_letters(self, of_piece: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """``of_piece`` and a row for each letter: ``UNKNOWN`` times the product of its bytes."""
        if not len(letters):
            return of_piece
        rows = [UNKNOWN * of_piece[self.byte + b.astype(int)].prod(axis=0) for b in self.bytes_of(letters)]
        return np.concatenate([of_piece, np.array(rows).reshape(len(rows), *of_piece.shape[1:])])

    def _symbols(self, codes: np.ndarray, count: int) -> np.ndarray:
        """Marked words of one length as numbers of characters."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).reshape(count, -1)

    def blocks(self, words: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, and the id of the piece of each width that ends at each position.

        ``ids[n, j, w]`` is the piece of word n from j - w to j + 1, or ``none``.
        """
        by_length: dict[int, list[int]] = {}
        for place, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(place)
        for length, places in by_length.items():
            widest = min(self.widest, length)
            most = max(1, _CELLS // (length * widest))
            for first in range(0, len(places), most):
                part = places[first:first + most]
                codes = self._codes([words[p] for p in part])
                symbols = self._symbols(codes, len(part))
                ids = np.full((len(part), length, widest), self.none, dtype=np.int32)
                row, at = (x.ravel() for x in np.indices(symbols.shape))
                node = np.zeros(len(row), dtype=np.int64)
                for w in range(widest):
                    edge = node * self.symbols + symbols[row, at + w]
                    found = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                    goes_on = self.edges[found] == edge
                    row, at, node = row[goes_on], at[goes_on], self.targets[found[goes_on]]
                    ids[row, at + w, w] = self.piece_at[node]
                    inside = at + w + 1 < length
                    row, at, node = row[inside], at[inside], node[inside]
                single = ids[:, :, 0]
                alone = single == self.none
                single[alone] = self.none + 1 + np.searchsorted(letters, codes.reshape(single.shape)[alone])
                yield np.array(part), ids

    @staticmethod
    def forward(ids: np.ndarray, of_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sums[j, n, l]``: the probability of the first j characters, in units of ``_SMALL ** scales[j, n, l]``."""
        count, length, widest = ids.shape
        sums = np.zeros((length + 1, count, of_piece.shape[1]))
        sums[0] = 1
        scales = np.zeros(sums.shape, dtype=np.int32)
        for j in range(length):
            first = max(0, j + 1 - widest)
            if count == 1:  # a long word: all widths at once
                sums[j + 1] = (sums[first:j + 1, 0][::-1] * of_piece[ids[0, j, :j + 1 - first]]).sum(axis=0)
            else:
                for w in range(min(widest, j + 1)):
                    sums[j + 1] += sums[j - w] * of_piece[ids[:, j, w]]
            scales[j + 1] = scales[j]
            low = sums[j + 1] < _SMALL
            if low.any():  # long words: scale up all that later positions read
                sums[first:j + 2, low] /= _SMALL
                scales[first:j + 2, low] += 1
        return sums, scales

    def log_probabilities(self, words: list[str], of_piece: np.ndarray) -> np.ndarray:
        """For each word and language, the log probability summed over all segmentations."""
        out = np.zeros((len(words), of_piece.shape[1]))
        letters = self.spelled(words)
        of_piece = self.with_letters(of_piece, letters)
        for places, ids in self.blocks(words, letters):
            sums, scales = self.forward(ids, of_piece)
            out[places] = np.log(sums[-1]) + scales[-1] * np.log(_SMALL)
        return out

    def _mirrored(self, ids: np.ndarray) -> np.ndarray:
        """The pieces as they are met reading the words from their ends."""
        out = np.full_like(ids, self.none)
        for w in range(ids.shape[2]):
            out[:, w:, w] = ids[:, ::-1, w][:, :ids.shape[1] - w]
        return out

    def expected_counts(self, words: list[str], weights: np.ndarray, of_piece: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in all segmentations; ``of_piece`` is one language's column."""
        letters = self.spelled(words)
        of_piece = self.with_letters(of_piece, letters)
        counts = np.zeros(len(of_piece))
        p = of_piece[:, None]
        for places, ids in self.blocks(words, letters):
            length, widest = ids.shape[1:]
            sums, scales = (x[:, :, 0] for x in self.forward(ids, p))
            ends, end_scales = (x[::-1, :, 0] for x in self.forward(self._mirrored(ids), p))
            for w in range(widest):  # a piece from j to j + w + 1; the scales cancel out but for a few
                scale = scales[:length - w] + end_scales[w + 1:] - scales[length]
                piece = ids[:, w:, w].T
                with np.errstate(divide="ignore"):  # no piece there: log 0
                    use = (np.log(sums[:length - w]) + np.log(of_piece)[piece] + np.log(ends[w + 1:])
                           - np.log(sums[length]) + scale * np.log(_SMALL))
                use = np.exp(use) * weights[places]
                counts += np.bincount(piece.ravel(), weights=use.ravel(), minlength=len(counts))
        for n, spelling in zip(counts[self.none + 1:], self.bytes_of(letters)):
            np.add.at(counts, self.byte + spelling.astype(int), n)
        return counts[:self.none + 1]


class Model:
    """``of_piece[i, l]``: the probability of piece i in language l.  ``others``: broadcasts of the same for
    further languages, later in string order."""

    def __init__(self, pieces: list[str], languages: list[str], of_piece: np.ndarray):
        self.pieces, self.languages, self.of_piece = pieces, languages, of_piece
        self.others: list[Broadcast] = []


def _probabilities(counts: np.ndarray, size: int) -> np.ndarray:
    """Smoothed probabilities of the pieces, then those of bytes within letters without a piece, and 0 for none."""
    own, spelled = counts[:size] + SMOOTHING, counts[size:size + BYTES] + BYTE_SMOOTHING
    return np.concatenate([own / own.sum(), spelled / spelled.sum(), [0.0]])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from=None,
        vocabulary: str = VOCABULARY, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language of ``docs``' labelled rows for which ``learn_from`` holds.

    ``learn_from`` is a column over ``id``, or None for all rows.  A language with more
    than ``fit_rows`` rows gives that many on average, chosen by a hash of their ids.
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary)
    given = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"),
                        col(text_col).alias("text")).where("lang is not null")
    given = given if learn_from is None else given.where(learn_from)
    sizes = sorted((r["lang"], r["count"]) for r in given.groupBy("lang").count().collect())
    if not sizes:
        return Model(pieces, [], np.zeros((len(pieces) + BYTES + 1, 0)))
    blocks = [sizes[i:i + LANGUAGES] for i in range(0, len(sizes), LANGUAGES)]
    first, *rest = blocks
    model = _fit_block(given, pieces, first, len(blocks) > 1, fit_rows, rounds)
    for block in rest:
        model.others.append(spark.sparkContext.broadcast(_fit_block(given, pieces, block, True, fit_rows, rounds)))
    return model


def _fit_block(given: DataFrame, pieces: list[str], sizes: list[tuple[str, int]], chosen: bool, fit_rows: int,
               rounds: int) -> Model:
    """The model of the languages in ``sizes``, with their numbers of rows in ``given``: id, lang, text."""
    spark = given.sparkSession
    languages = [lang for lang, _ in sizes]
    if chosen:
        given = given.where(F.col("lang").isin(languages))
    shares = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, fit_rows / n))])
    draw = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.update((lang, w) for w in words_of(text.as_py()) if has_letter(w))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = (given.where(draw < shares[F.col("lang")]).select("lang", "text")
             .mapInArrow(counted, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words = saved(words, "language-words")
    even = np.append(np.ones(len(pieces)), np.zeros(BYTES))
    of_piece = np.stack([_probabilities(even, len(pieces))] * len(languages), axis=1)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, languages, of_piece))

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, languages, of_piece = shared.value
            lattice = Lattice(pieces)
            sums = np.zeros((len(pieces) + BYTES + 1, len(languages)))
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), dtype=object)
                texts, n = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for at, language in enumerate(languages):
                    mine = np.flatnonzero(langs == language)
                    if len(mine):
                        sums[:, at] += lattice.expected_counts([texts[i] for i in mine], n[mine], of_piece[:, at])
            piece, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(at, pa.int32()),
                                              pa.array(sums[piece, at])], names=["piece", "at", "n"])

        # rounded before they are summed, so that the order of tasks changes nothing
        counts = (words.mapInArrow(expected, "piece int, at int, n double")
                  .groupBy("piece", "at").agg(F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n")).toPandas())
        sums = np.zeros((len(pieces) + BYTES + 1, len(languages)))
        sums[counts.piece, counts["at"]] = counts.n / 1e6
        of_piece = np.stack([_probabilities(c, len(pieces)) for c in sums.T], axis=1)
        shared.unpersist()
    return Model(pieces, languages, of_piece)


class Scorer:
    """Scores texts with a model; words seen before are looked up."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.most = min(REMEMBERED, REMEMBERED_CELLS // max(1, len(model.languages)))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.model.languages)))

    def _remember(self, words: list[str]) -> None:
        start = len(self.place)
        if start + len(words) > len(self.logs):
            more = np.zeros((max(2 * len(self.logs), start + len(words)), self.logs.shape[1]))
            more[:start] = self.logs[:start]
            self.logs = more
        self.logs[start:start + len(words)] = self.lattice.log_probabilities(words, self.model.of_piece)
        self.place.update(zip(words, range(start, start + len(words))))

    def best(self, texts: list[str | None]) -> list[Best]:
        """For each text its likeliest language, the log probability of that one, and the sum of all languages'
        probabilities relative to it."""
        if not self.model.languages:
            return [NOTHING] * len(texts)
        split = [words_of(t) for t in texts]
        if len(self.place) > self.most:
            self._forget()
        new = sorted(w for w in set().union(*split) if w not in self.place) if split else []
        if new:
            self._remember(new)
        out = []
        for words in split:
            if not any(map(has_letter, words)):
                out.append(NOTHING)
                continue
            rows = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            logs = self.logs[rows].sum(axis=0)
            top = int(logs.argmax())
            out.append((self.model.languages[top], float(logs[top]), float(np.exp(logs - logs[top]).sum())))
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``(language, score)`` of each text."""
        return [(language, score_of(total)) for language, _, total in self.best(texts)]


Best = tuple[str, float, float]
NOTHING: Best = (UNDETERMINED, 0.0, 0.0)


def score_of(total: float) -> float:
    return 1 / total if total else 0.0


def better(a: Best, b: Best) -> Best:
    """The best over both blocks of languages; of equally likely ones that of ``a``, which come first."""
    if not a[2] or not b[2]:
        return a if a[2] else b
    high, low = (a, b) if a[1] >= b[1] else (b, a)
    return high[0], high[1], high[2] + low[2] * float(np.exp(low[1] - high[1]))


BEST = StructType().add("lang", "string").add("top", "double").add("total", "double")
_SCORERS: dict[str, Scorer] = {}  # of this worker, by the model's number
_TEXT = 1 << 21


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about two million characters together, so that few words are held at a time."""
    at, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= _TEXT or i == len(texts):
            yield texts[at:i]
            at, size = i, 0


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score`` of every row, and ``row``, a struct of the columns named in ``keep``."""
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("text"),
                        F.struct(*[col(c) for c in keep] or [F.lit(None).cast("int").alias("none")]).alias("row"))
    others, model = model.others, Model(model.pieces, model.languages, model.of_piece)
    if not others:
        return _with_best(given, docs.sparkSession.sparkContext.broadcast(model)).select(
            "id", "lang_pred", "score", "row")
    found = given.select("*", F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("top"),
                                       F.lit(0.0).alias("total")).alias("best"))
    shared = [docs.sparkSession.sparkContext.broadcast(model), *others]
    for block in shared[:-1]:
        found = saved(_with_best(found, block).select("id", "text", "row", "best"), "language-scores")
    return _with_best(found, shared[-1]).select("id", "lang_pred", "score", "row")


def _with_best(given: DataFrame, shared: Broadcast) -> DataFrame:
    """``given`` scored by one block of languages, and by those before if it has a column ``best``.

    Of ``text`` only what a further block needs is returned.
    """
    number = uuid.uuid4().hex
    several = "best" in given.columns
    schema = StructType().add(given.schema["id"]).add(given.schema["row"]).add("lang_pred", "string").add("score", "double")
    if several:
        schema = schema.add(given.schema["text"]).add("best", BEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(number)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[number] = Scorer(shared.value)
        for batch in batches:
            best = [x for part in _portions(batch.column(1).to_pylist()) for x in scorer.best(part)]
            if several:
                before = batch.column(3).to_pylist()
                best = [better((b["lang"], b["top"], b["total"]), x) for b, x in zip(before, best)]
            columns = [batch.column(0), batch.column(2), pa.array([x[0] for x in best], pa.string()),
                       pa.array([score_of(x[2]) for x in best], pa.float64())]
            if several:
                columns += [batch.column(1), pa.array([dict(zip(("lang", "top", "total"), x)) for x in best],
                                                      pa.struct([("lang", pa.string()), ("top", pa.float64()),
                                                                 ("total", pa.float64())]))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(run, schema)

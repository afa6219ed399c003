"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the buckets of its character n-grams (lower-cased, white space
folded), present or not.  Each feature is scaled by the log ratio of its smoothed document
frequencies in toxic and clean labelled texts, the vector is scaled to unit length, and a
logistic regression with L2 penalty is trained on it.  Features in fewer than
``least_count`` sampled texts, or with a log ratio near zero, are left out.

The fit uses at most about ``fit_rows`` labelled rows, those with the smallest hashes of
their ids.  Their features are counted by Spark; one task then fits on the sample's
features, whose size is bounded by ``fit_rows`` times the number of buckets.  Scoring reads
every whole text once and shuffles nothing.

Defined cases: null and empty texts have no features and score the intercept's
probability.  Rows without a label or with one other than 0 and 1 are not learned from; of
several labels of an id the larger counts.  Without any labelled row, or with one label
only, the score is the smoothed share of toxic labels.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .common import col, saved

FIT_ROWS = 10_000
_PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    lengths: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    smoothing: float = 1.0
    least_count: int = 4
    least_ratio: float = 0.3
    penalty: float = 1e-5
    rounds: int = 150


class Features:
    """The sorted buckets of the character n-grams that a text has."""

    def __init__(self, settings: Settings):
        self.lengths, self.bits = settings.lengths, settings.bits
        self.seen = np.zeros(1 << settings.bits, dtype=bool)

    def __call__(self, text: str | None) -> np.ndarray:
        folded = " ".join((text or "").lower().split())
        if not folded:
            return np.empty(0, dtype=np.int32)
        chars = np.frombuffer(f" {folded} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        longest = max(self.lengths)
        for at in range(0, len(chars), _PIECE):
            piece = chars[at:at + _PIECE + longest - 1]
            hashes = piece
            for n in range(2, longest + 1):
                if len(piece) < n:
                    break
                hashes = hashes[:-1] * np.uint32(0x01000193) + piece[n - 1:]
                if n in self.lengths:
                    mixed = hashes * np.uint32(0x9E3779B1) + np.uint32(n)
                    self.seen[mixed >> np.uint32(32 - self.bits)] = True
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


class Model:
    """``weights`` of the unit-length scaled features; ``ratios`` scale them."""

    def __init__(self, settings: Settings, ratios: np.ndarray, weights: np.ndarray, intercept: float):
        self.settings, self.intercept = settings, float(intercept)
        self.squares = (ratios * ratios).astype(np.float32)
        self.products = (ratios * weights).astype(np.float32)

    def score(self, features: np.ndarray) -> float:
        norm = np.sqrt(self.squares[features].sum(dtype=np.float64))
        z = self.intercept
        if norm > 0:
            z += self.products[features].sum(dtype=np.float64) / norm
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fitted(settings: Settings, features: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of a sample: accelerated gradient descent on the penalised mean log loss."""
    size = 1 << settings.bits
    positive = int(labels.sum())
    prior = np.log((positive + 1) / (len(labels) - positive + 1))
    if positive in (0, len(labels)):
        return Model(settings, np.zeros(size), np.zeros(size), prior)
    counts = np.zeros((2, size))
    for label, found in zip(labels, features):
        counts[label, found] += 1  # a text has each feature once
    a = settings.smoothing
    in_clean, in_toxic = (counts + a) / (np.bincount(labels, minlength=2)[:, None] + 2 * a)
    ratios = np.log(in_toxic) - np.log(in_clean)
    kept = (counts.sum(axis=0) >= settings.least_count) & (np.abs(ratios) >= settings.least_ratio)
    ratios = np.where(kept, ratios, 0).astype(np.float32)

    chosen = [found[kept[found]] for found in features]
    used = [i for i, found in enumerate(chosen) if len(found)]
    if not used:
        return Model(settings, ratios, np.zeros(size), prior)
    y = labels[used].astype(np.float32)
    lengths = np.array([len(chosen[i]) for i in used])
    index = np.concatenate([chosen[i] for i in used])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def spread(values):  # one value for each row -> one for each feature of the row
        return np.repeat(values.astype(np.float32), lengths)

    values = ratios[index]
    values /= spread(np.sqrt(np.add.reduceat(values * values, starts)))

    def times(w):
        return np.add.reduceat(values * w[index], starts)

    def back(r):
        return np.bincount(index, weights=values * spread(r), minlength=size)

    step = 1 / (0.5 + settings.penalty)  # unit rows and an intercept: a quarter of at most two
    w, b, at_w, at_b, t = np.zeros(size, np.float32), prior, np.zeros(size, np.float32), prior, 1.0
    for _ in range(settings.rounds):
        error = (1 / (1 + np.exp(-(times(at_w) + at_b))) - y) / len(y)
        new_w = (at_w - step * (back(error) + settings.penalty * at_w)).astype(np.float32)
        new_b = at_b - step * error.sum()
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w = new_w + np.float32((t - 1) / further) * (new_w - w)
        at_b = new_b + (t - 1) / further * (new_b - b)
        w, b, t = new_w, new_b, further
    return Model(settings, ratios, w, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", learn_from=None, fit_rows: int = FIT_ROWS,
        settings: Settings = Settings()) -> Model:
    """The classifier of the labelled rows of ``docs`` for which ``learn_from`` holds.

    ``learn_from`` is a column over ``id``, or None for all rows.
    """
    known = (labels.select(col(id_col).alias("id"), col(label_col).alias("label"))
             .where("id is not null and label in (0, 1)"))
    known = known if learn_from is None else known.where(learn_from)
    known = known.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    sample = saved(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows), "toxicity-sample")
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    # one row for each id, so at most fit_rows rows; of rows that repeat an id, the text of the smallest hash
    chosen = (texts.join(F.broadcast(sample), "id").groupBy("id", "label")
              .agg(F.min(F.struct(F.isnull("text").alias("missing"), F.xxhash64("text").alias("hash"), "text")).alias("least"))
              .select("id", "label", F.col("least.text").alias("text")))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(settings)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([of(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))],
                names=["id", "label", "features"])

    schema = StructType().add(chosen.schema["id"]).add(chosen.schema["label"]).add("features", ArrayType(IntegerType()))
    rows = saved(chosen.select("id", "label", "text").mapInArrow(featured, schema), "toxicity-features")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = []
        for batch in batches:
            given += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                         [f.values.to_numpy() for f in batch.column(2)])
        given.sort(key=lambda row: row[0])  # rows arrive in any order; sums of floats follow theirs
        model = fitted(settings, [f for _, _, f in given], np.array([y for _, y, _ in given], dtype=np.int64))
        at = np.flatnonzero((model.squares != 0) | (model.products != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()),
             pa.array(np.append(model.squares[at].astype(float), 0.0)),
             pa.array(np.append(model.products[at].astype(float), model.intercept))],
            names=["bucket", "square", "product"])

    learned = (rows.select("id", "label", "features").coalesce(1)
               .mapInArrow(train, "bucket int, square double, product double").toPandas())
    model = Model(settings, np.zeros(1 << settings.bits), np.zeros(1 << settings.bits), np.log(0.5 / 0.5))
    own = learned.bucket >= 0
    model.squares[learned.bucket[own]] = learned.square[own]
    model.products[learned.bucket[own]] = learned["product"][own]
    if not own.all():
        model.intercept = float(learned["product"][~own].iloc[0])
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        of = Features(learned.settings)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([learned.score(of(t.as_py())) for t in batch.column(1)], pa.float64())],
                names=["id", "score"])

    return given.mapInArrow(run, StructType().add(given.schema["id"]).add("score", DoubleType()))

"""Splits, multilayer perceptron and accuracy on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_point import to_fixed
from ..session import scratch_path


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 1234):
    """Spark's ``randomSplit``; reproducible only for the same input partitioning."""
    return df.randomSplit(list(weights), seed)


def hash_bucket(key, buckets: int = 100, method: str = "md5"):
    """Bucket of a key, stable under repartitioning and retries.

    ``"md5"``: ``int(first 8 hex digits of md5(str(key)), 16) mod buckets``,
    reproducible in any SQL engine.  ``"xxhash64"``: Spark's native 64-bit
    hash, several times cheaper per row, Spark-only.
    """
    k = F.col(key) if isinstance(key, str) else key
    if method == "xxhash64":
        return F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")
    if method != "md5":
        raise ValueError("method must be 'md5' or 'xxhash64'")
    return (F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long")
            % F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, key: str, train_percent: int = 80, name: str = "split",
               method: str = "md5") -> DataFrame:
    """Add ``split`` = ``train`` / ``test`` from a hash of the key (no shuffle, no sort)."""
    return df.withColumn(name, F.when(hash_bucket(key, method=method) < train_percent,
                                      F.lit("train")).otherwise(F.lit("test")))


def _hash60(key):
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


_PASS_BITS = 15


def _cuts(keys: DataFrame, ranks: Sequence[int]) -> list[tuple[int, object]]:
    """For each rank the hash and key of the row ``(h, key)`` with that many rows before it.

    A pass counts 15 more bits of the hashes that begin like one of the rows looked for, so
    it brings at most 2^15 counts a rank to the driver; four passes know all 60 bits.
    """
    found = [(0, rank) for rank in ranks]  # (leading bits, rows before it among those that begin so)
    for done in range(0, 60, _PASS_BITS):
        left = 60 - done - _PASS_BITS
        head = F.shiftright("h", left + _PASS_BITS)
        counted = keys.where(head.isin(sorted({p for p, _ in found}))).groupBy(
            F.shiftright("h", left).alias("head")).count().collect()
        counts = sorted((r.head, r["count"]) for r in counted)
        for k, (prefix, rank) in enumerate(found):
            for head_value, many in counts:
                if head_value >> _PASS_BITS != prefix:
                    continue
                if rank < many:
                    found[k] = (head_value, rank)
                    break
                rank -= many
    cuts = []
    for value, rank in found:  # keys of one 60-bit hash: hardly ever more than one
        same = sorted(r.key for r in keys.where(F.col("h") == value).select("key").collect())
        cuts.append((value, same[rank]))
    return cuts


def exact_split(df: DataFrame, key: str, weights: dict[str, float], name: str = "split") -> DataFrame:
    """Add ``split``: parts of exactly the given shares, by the order of a hash of the key.

    Of ``n`` distinct keys, the first parts together get ``floor(share * n + 0.5)``, whatever
    the partitioning; rows of one key stay together.  The hash is the first 15 hex digits of
    the MD5 of the key as text, equal hashes go by key.  Where the parts begin is found by
    counting, without sorting; the rows themselves are not shuffled.  A null key fails.
    """
    if not weights or min(weights.values()) < 0 or not sum(weights.values()) > 0:
        raise ValueError("weights must be positive")
    spark = df.sparkSession
    own = F.col(key)
    own = F.when(own.isNotNull(), own).otherwise(F.raise_error(F.lit("vecreduce: null key")).cast(df.schema[key].dataType))
    path = scratch_path(spark, "split-keys")
    df.select(own.alias("key")).distinct().withColumn("h", _hash60(F.col("key"))).write.parquet(path)
    keys = spark.read.parquet(path)
    n, total, share, ranks = keys.count(), float(sum(weights.values())), 0.0, []
    for weight in list(weights.values())[:-1]:
        share += weight
        ranks.append(int(share / total * n + 0.5))
    cuts = dict(zip(inside, _cuts(keys, inside))) if (inside := sorted({r for r in ranks if r < n})) else {}
    h, part = _hash60(own), F.lit(list(weights)[-1])
    for label, rank in reversed(list(zip(weights, ranks))):
        if rank in cuts:
            at, first = cuts[rank]
            part = F.when((h < at) | ((h == at) & (own < F.lit(first))), F.lit(label)).otherwise(part)
        else:
            part = F.lit(label)
    return df.withColumn(name, part)


def vector_features(df: DataFrame, vec: str, name: str = "features") -> DataFrame:
    """An array column as an ML dense vector, all its elements."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(name, array_to_vector(F.col(vec).cast("array<double>")))


def strided_label(vec: str, classes: int):
    """The class whose elements (those with ``dim mod classes`` equal to it) sum highest, as a double.

    Sums are fixed point, so every engine gives the same label; the lowest of equal classes.
    """
    def total(c):
        mine = F.filter(F.col(vec), lambda x, i: i % classes == c)
        return F.aggregate(F.transform(mine, lambda x: to_fixed(x)), F.lit(0).cast("long"), lambda s, x: s + x)

    sums = F.array(*[total(c) for c in range(classes)])
    return (F.array_position(sums, F.array_max(sums)) - 1).cast("double")


def mlp_fit(train: DataFrame, layers: Sequence[int], block_size: int = 128, seed: int = 1234,
            max_iter: int = 100, features: str = "features", label: str = "label"):
    """Fit ``MultilayerPerceptronClassifier`` (L-BFGS; gradients tree-aggregated by Spark ML)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    trainer = MultilayerPerceptronClassifier(layers=list(layers), blockSize=block_size, seed=seed,
                                             maxIter=max_iter, featuresCol=features, labelCol=label)
    return trainer.fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def mlp_weights(spark, layers: Sequence[int], weights: Sequence[float]) -> DataFrame:
    """A fitted network as a table ``(layer, unit, input, w)``; a unit's bias is the input after the last.

    ``weights`` are those of Spark ML's model: for each layer a matrix by columns, a column
    an input, then the biases.
    """
    import pandas as pd

    expected = sum((inputs + 1) * units for inputs, units in zip(layers, layers[1:]))
    if expected != len(weights):
        raise ValueError(f"layers {tuple(layers)} have {expected} weights, not {len(weights)}")
    rows, at = [], 0
    for layer, (inputs, units) in enumerate(zip(layers, layers[1:])):
        for i in range(inputs + 1):
            rows += [(layer, u, i, float(weights[at + i * units + u])) for u in range(units)]
        at += (inputs + 1) * units
    return spark.createDataFrame(pd.DataFrame(rows, columns=["layer", "unit", "input", "w"]),
                                 "layer int, unit int, input int, w double")


def _weighted_sum(given):
    """The sum of a row of weights times the elements of ``given``."""
    return lambda row: F.aggregate(F.zip_with(row, given, lambda w, v: w * v), F.lit(0.0), lambda s, v: s + v)


def mlp_forward(df: DataFrame, table: DataFrame, features: str, name: str = "prediction") -> DataFrame:
    """Add the class that the network of ``table`` predicts for the array ``features``, as a double.

    Sigmoid layers, the largest output wins, the lowest of equal ones.  The table is read
    once, and its weights, as many as the model's, stand in the expression.  A vector of
    another length than the first layer's fails.
    """
    units: dict[tuple[int, int], dict[int, float]] = {}
    for r in table.collect():
        units.setdefault((r.layer, r.unit), {})[r["input"]] = r.w
    last = max(layer for layer, _ in units)
    x = F.col(features).cast("array<double>")
    for layer in range(last + 1):
        rows = [[units[layer, u][i] for i in range(len(units[layer, u]))] for u in range(sum(k == layer for k, _ in units))]
        inputs = len(rows[0]) - 1
        x = F.when(F.size(x) == inputs, x).otherwise(F.raise_error(F.lit(f"vecreduce: not {inputs} inputs")))
        matrix = F.array(*[F.array(*[F.lit(w) for w in row]) for row in rows])
        with_one = F.concat(x, F.array(F.lit(1.0)))

        x = F.transform(matrix, _weighted_sum(with_one))
        if layer < last:
            x = F.transform(x, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
        df = df.withColumn("_layer", x)
        x = F.col("_layer")
    return df.withColumn(name, (F.array_position("_layer", F.array_max("_layer")) - 1).cast("double")).drop("_layer")


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """``(accuracy, cnt)``: share of rows whose prediction equals the label, as a DataFrame."""
    hit = F.when(F.col(prediction) == F.col(label), F.lit(1)).otherwise(F.lit(0))
    return df.agg((F.sum(hit).cast("double") / F.count(F.lit(1))).alias("accuracy"),
                  F.count(F.lit(1)).alias("cnt"))


def evaluate_accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> float:
    """Same number through ``MulticlassClassificationEvaluator`` (an action)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    ev = MulticlassClassificationEvaluator(metricName="accuracy", predictionCol=prediction,
                                           labelCol=label)
    return ev.evaluate(df.select(F.col(prediction).cast("double").alias(prediction),
                                 F.col(label).cast("double").alias(label)))

"""User-defined aggregates: a state with zero, add, merge and value, folded in tasks.

``add`` takes a state and a batch of a key's values as numpy arrays, so Python runs once for
a key and batch.  Each task folds its rows into a state for each key and ships the states,
at most one a task and key unless they outgrow ``most_states``; states then merge level by
level.  The first levels are salted by task, so a key that every task has does not bring
all its states to one task.  A merging task reads its states in order of key and holds one.

Merging must not depend on order (``merge`` commutative and associative): then results do
not depend on partitions, and a retried task changes nothing.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


class Aggregate:
    """What a user-defined aggregate gives: its result columns and four functions of a state."""

    #: DDL of the result columns.
    returns: str

    def zero(self):
        raise NotImplementedError

    def add(self, state, *values: np.ndarray):
        """The state with a batch of a key's values; may change ``state``."""
        raise NotImplementedError

    def merge(self, state, other):
        """Both states as one; may change ``state``."""
        raise NotImplementedError

    def value(self, state) -> tuple:
        raise NotImplementedError


class Moments(Aggregate):
    """Exact count and sums of the first four powers of integers, whatever their size."""

    returns = "cnt long, s1 decimal(38,0), s2 decimal(38,0), s3 decimal(38,0), s4 decimal(38,0)"

    def zero(self):
        return [0, 0, 0, 0, 0]

    def add(self, state, values):
        most = max(-int(values.min()), int(values.max()))
        if most ** 4 * len(values) >= 1 << 63:
            values = values.astype(object)  # whole numbers of any size
        state[0] += len(values)
        power = 1
        for k in range(1, 5):
            power = power * values
            state[k] += int(power.sum())
        return state

    def merge(self, state, other):
        return [a + b for a, b in zip(state, other)]

    def value(self, state):
        from decimal import Decimal
        return state[0], *map(Decimal, state[1:])


class Largest(Aggregate):
    """The ``k`` largest distinct values, largest first, and how often each occurs."""

    returns = "largest array<bigint>, times array<bigint>"

    def __init__(self, k: int = 3):
        self.k = k

    def zero(self):
        return {}

    def _kept(self, state):
        return {v: state[v] for v in sorted(state, reverse=True)[:self.k]}

    def add(self, state, values):
        distinct, times = np.unique(values, return_counts=True)
        return self.merge(state, dict(zip(distinct[-self.k:].tolist(), times[-self.k:].tolist())))

    def merge(self, state, other):
        for v, n in other.items():
            state[v] = state.get(v, 0) + n
        return self._kept(state)

    def value(self, state):
        best = sorted(state, reverse=True)
        return best, [state[v] for v in best]


def _folded(aggregate: Aggregate, most_states: int, schema: StructType):
    """A task's rows as states: ``(key, salt, state)``."""
    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        part = TaskContext.get().partitionId()
        states: dict = {}

        def emitted(key_type):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(states), key_type), pa.array([part] * len(states), pa.int32()),
                 pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=schema.names)

        key_type = None
        for batch in batches:
            keys = batch.column(0)
            key_type = keys.type
            order = pc.sort_indices(keys)
            sorted_keys = keys.take(order)
            runs = pc.run_end_encode(sorted_keys)
            columns = [c.take(order).to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            start = 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                state = states[key] if key in states else aggregate.zero()
                states[key] = aggregate.add(state, *[c[start:end] for c in columns])
                start = end
            if len(states) > most_states:
                yield emitted(key_type)
                states = {}
        if states:
            yield emitted(key_type)

    return fold


def _merged(aggregate: Aggregate, names: list[str], finish: bool, schema: StructType):
    """States in order of their keys, merged to one a key: the state, or its value."""
    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        key = state = None
        held = False
        out: list[tuple] = []

        def done():
            out.append((*key, *aggregate.value(state)) if finish else (*key, pickle.dumps(state)))

        def emitted():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for *at, raw in zip(*columns, batch.column("state").to_pylist()):
                if held and at == key:
                    state = aggregate.merge(state, pickle.loads(raw))
                    continue
                if held:
                    done()
                key, state, held = at, pickle.loads(raw), True
            if len(out) >= 1_000:
                yield emitted()
                out = []
        if held:
            done()
        if out:
            yield emitted()

    return merge


def aggregate_by_key(df: DataFrame, key: str, values: Sequence[str], aggregate: Aggregate,
                     levels: Sequence[int] = (16,), most_states: int = 200_000) -> DataFrame:
    """``(key, *returns)``: ``aggregate`` over the rows of each key.

    ``values`` are numeric columns; a row with a null among them, or in the key, fails.
    ``levels`` are the numbers of salts of the merges before the last.
    """
    given = df.select(F.col(key).alias("key"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    whole = F.lit(True)
    for c in given.columns:
        whole = whole & F.col(c).isNotNull()
    missing = F.raise_error(F.lit("vecreduce: null key or value")).cast(given.schema["key"].dataType)
    given = given.withColumn("key", F.when(whole, F.col("key")).otherwise(missing))
    key_field = given.schema["key"]
    partial = StructType([key_field]).add("salt", "integer").add("state", "binary")
    states = given.mapInArrow(_folded(aggregate, most_states, partial), partial)
    for salts in levels:
        salted = states.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
        near = salted.repartition("key", "salt").sortWithinPartitions("key", "salt")
        states = near.mapInArrow(_merged(aggregate, ["key", "salt"], False, partial), partial)
    result = StructType([key_field])
    for field in StructType.fromDDL(aggregate.returns):
        result = result.add(field)
    near = states.select("key", "state").repartition("key").sortWithinPartitions("key")
    found = near.mapInArrow(_merged(aggregate, ["key"], True, result), result)
    return found.withColumnRenamed("key", key)

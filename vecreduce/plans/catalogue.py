"""Query catalogue: every inventory item as a Spark query over the driver tables,
with the equivalent SQL for the DuckDB oracle where SQL can express it.

Conventions (shared by both sides, so results hash equal):

* vector elements become BIGINT fixed point, ``floor(double(x) * 1e6 + 0.5)``;
  money becomes cents, ``floor(value * 100 + 0.5)``;
* worker of an embedding = ``vec_id mod 8``; groups are blocks of 4 workers;
* sums that can outgrow BIGINT (squares, products) are exact wide sums returned as DOUBLE
  (Spark: three BIGINT limb sums; SQL: a DECIMAL(38,0) sum; same value);
* every computed column is aliased to the same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from .. import sources as src
from ..functions import CENTS, EMBEDDING_SCALE, checked, exact_sum, exact_sum_over, from_fixed, to_fixed, worker_of
from ..session import scratch_path

# Fixed parameters of the catalogue (the reference's ring of 8 workers, two groups of 4,
# learning rate 0.2, MLP with hidden layers 5 and 4 and three classes, split 80/20).
WORKERS = 8
GROUP_SIZE = 4
LR = 0.2
MLP_LAYERS = (64, 5, 4, 3)  # inputs: the length of the embeddings
TRAIN_PERCENT = 80
LS_LR = 20.0
LS_ITERATIONS = 5
LS_SCALE = 10_000
BLOCK = 16
LEVELS = (8,)  # salts of the first level of a tree-shaped merge
SPLIT_BYTES = 1 << 16  # of the files that queries write and read, so that lines are cut
SPLIT = {"train": 0.8, "check": 0.05, "test": 0.15}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]
    note: str = ""


# --------------------------------------------------------------------------- helpers

def _emb(spark, sf, cols=("vec_id", "embedding")):
    return src.embeddings(spark, sf, cols)


def _long(spark, sf):
    return op.to_long(_emb(spark, sf), "embedding", "vec_id", WORKERS)


def _cents(events: DataFrame) -> DataFrame:
    return events.select("user_id", to_fixed(checked("value"), CENTS).alias("c"))


# SQL prefix: the long cells and the per-(worker, dim) sums.
BASE = """
with long as (
  select cast(((vec_id % 8) + 8) % 8 as int) as worker,
         cast(unnest(range(len(embedding))) as int) as dim,
         cast(floor(cast(unnest(embedding) as double) * 1e6 + 0.5) as bigint) as g
  from embeddings),
local as (select worker, dim, cast(sum(g) as bigint) as g from long group by worker, dim)
"""

SQL_TOTALS = BASE + "select dim, cast(sum(g) as bigint) as total from long group by dim"

SQL_CENTS = "cast(floor(value * 100 + 0.5) as bigint)"


# --------------------------------------------------------------------------- queries

def q_matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spark, sf)


def q_range_source(spark: SparkSession, sf: str) -> DataFrame:
    """Events of every user id from the smallest to the largest, none included."""
    ev = src.events(spark, sf, ["user_id"])
    low, high = ev.agg(F.min("user_id"), F.max("user_id")).first()
    ids = src.range_source(spark, low, high + 1, name="user_id") if low is not None else src.range_source(
        spark, 0, 0, name="user_id")
    return op.with_default(ids, ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt")), "user_id", "cnt", 0)


def q_libsvm_source(spark: SparkSession, sf: str) -> DataFrame:
    lines = src.libsvm_lines(_emb(spark, sf, ("label", "embedding")), features="embedding")
    back = src.parse_libsvm(lines)
    cells = back.select("label", F.posexplode_outer(F.arrays_zip("indices", "values")).alias("pos", "e"))
    return cells.groupBy("label").agg(
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("cnt"),  # a row's first entry, or none
        F.coalesce(exact_sum(to_fixed("e.values")), F.lit(0)).alias("total"))


def q_dense_text_source(spark: SparkSession, sf: str) -> DataFrame:
    back = src.parse_dense(src.dense_lines(_emb(spark, sf, ("embedding",)), "embedding"))
    cells = back.select(F.posexplode("vec").alias("dim", "x")).select("dim", to_fixed("x").alias("g"))
    return op.all_reduce(cells)


def q_event_gradients(spark: SparkSession, sf: str) -> DataFrame:
    return op.event_gradients(src.events(spark, sf, ["ts", "user_id", "event_type", "value"]),
                              WORKERS, CENTS)


def q_matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return src.matrix_rows(_long(spark, sf))


def q_scatter_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return op.scatter_reduce(_long(spark, sf), WORKERS)


def q_group_scatter_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return op.scatter_reduce(_long(spark, sf), WORKERS, group_size=GROUP_SIZE)


def q_all_gather(spark: SparkSession, sf: str) -> DataFrame:
    return op.all_gather(_long(spark, sf), WORKERS)


def q_cross_group_merge(spark: SparkSession, sf: str) -> DataFrame:
    return op.cross_group_merge(_long(spark, sf), GROUP_SIZE, WORKERS)


def q_keyed_sum_default(spark: SparkSession, sf: str) -> DataFrame:
    ev = src.events(spark, sf, ["user_id", "event_type", "value"])
    domain = src.key_domain(ev, "user_id")
    bought = _cents(ev.where(F.col("event_type") == "purchase"))
    return op.with_default(domain, op.keyed_sum(bought, "user_id", "c"), "user_id", "total", 0)


def q_assemble_vector(spark: SparkSession, sf: str) -> DataFrame:
    vecs = op.assemble(_long(spark, sf), keys=["worker"], value="g", name="vec", dense=True)
    cells = op.explode_vector(vecs, "vec", keys=["worker"], value="g")
    return cells.select("worker", "dim", from_fixed("g").alias("v"))


def q_keyed_sum(spark: SparkSession, sf: str) -> DataFrame:
    return op.keyed_sum(_cents(src.events(spark, sf, ["user_id", "value"])), "user_id", "c")


def q_hierarchical_all_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return op.hierarchical_all_reduce(_long(spark, sf), GROUP_SIZE)


def q_hierarchical_all_reduce_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return op.hierarchical_all_reduce(_long(spark, sf), GROUP_SIZE, method="rollup")


def q_keyed_set(spark: SparkSession, sf: str) -> DataFrame:
    ev = src.events(spark, sf, ["event_id", "ts", "user_id", "value"])
    return op.keyed_set(ev, "user_id", "value", ["ts", "event_id"])


def q_all_reduce_sum(spark: SparkSession, sf: str) -> DataFrame:
    return op.all_reduce(_long(spark, sf))


def q_group_all_gather(spark: SparkSession, sf: str) -> DataFrame:
    return op.group_all_gather(_long(spark, sf), GROUP_SIZE, WORKERS)


def q_gd_step(spark: SparkSession, sf: str) -> DataFrame:
    return op.gd_step(op.all_reduce(_long(spark, sf)), LR, WORKERS, EMBEDDING_SCALE)


def q_tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    ev = src.events(spark, sf, ["value"]).select(to_fixed(checked("value"), CENTS).alias("c"))
    return op.tree_stats(ev, {"grad": "c"}, ("c", "c"))


def q_gradient_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The whole embedding as the gradient, the label as the loss."""
    return op.gradient_stats(_emb(spark, sf, ("label", "embedding")), "embedding", "label", loss_scale=1)


def q_vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return op.vector_stats(_long(spark, sf))


def q_gd_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    ev = src.events(spark, sf, ["ts", "user_id", "event_type", "value"])
    return op.gd_trajectory(op.event_cells(ev, WORKERS, CENTS), LR, WORKERS, CENTS, 1.0,
                            dim="event_type")


def q_least_squares_gradient(spark: SparkSession, sf: str) -> DataFrame:
    li = src.lineitem(spark, sf, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    feats = [to_fixed("l_quantity", 1), to_fixed("l_discount", 100), to_fixed("l_tax", 100),
             F.lit(1).cast("long")]
    return op.ls_gradient(li, feats, to_fixed("l_extendedprice", 1), [1, 1, 1, 1], exact=True,
                          names=["g_quantity", "g_discount", "g_tax", "g_bias"])


def q_least_squares_fit(spark: SparkSession, sf: str) -> DataFrame:
    return op.ls_fit(_emb(spark, sf, ("label", "embedding")), "embedding", "label", LS_LR, LS_ITERATIONS, LS_SCALE)


def q_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return op.hash_split(_emb(spark, sf, ("vec_id",)), "vec_id", TRAIN_PERCENT)


def _mlp_frame(spark, sf):
    emb = _emb(spark, sf, ("vec_id", "embedding"))
    emb = emb.withColumn("label", op.strided_label("embedding", MLP_LAYERS[-1]))
    return op.hash_split(op.vector_features(emb, "embedding"), "vec_id", TRAIN_PERCENT)


_PREDICTIONS: dict[tuple[str, str], str] = {}  # where a session last stored the model's predictions


def _mlp_predictions(spark, sf, fit: bool = True):
    """The fitted model's predictions of the test rows; without ``fit`` those that the session has, if any."""
    own = (spark.sparkContext.applicationId, sf)
    if fit or own not in _PREDICTIONS:
        data = _mlp_frame(spark, sf)
        model = op.mlp_fit(data.where(F.col("split") == "train"), MLP_LAYERS)
        path = scratch_path(spark, "mlp-predictions")
        op.predict(model, data.where(F.col("split") == "test")).select("vec_id", "label", "prediction").write.parquet(path)
        _PREDICTIONS[own] = path
    return spark.read.schema("vec_id long, label double, prediction double").parquet(_PREDICTIONS[own])


def q_mlp_input(spark: SparkSession, sf: str) -> DataFrame:
    return _mlp_frame(spark, sf).select("vec_id", "split", "label")


def q_mlp_fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _mlp_predictions(spark, sf, fit=True)


def q_mlp_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return op.accuracy(_mlp_predictions(spark, sf, fit=False))


def q_mlp_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The forward pass of a network whose weights a rule gives, over all embeddings."""
    sizes = enumerate(zip(MLP_LAYERS, MLP_LAYERS[1:]))
    flat = [((31 * layer + 17 * u + 7 * i) % 23 - 11) / 10 for layer, (inputs, units) in sizes
            for i in range(inputs + 1) for u in range(units)]
    table = op.mlp_weights(spark, MLP_LAYERS, flat)
    return op.mlp_forward(_emb(spark, sf), table, "embedding").select("vec_id", "prediction")


def _blocks(spark, sf):
    return op.to_blocks(_emb(spark, sf), "embedding", "vec_id", WORKERS, BLOCK)


def q_block_all_reduce(spark: SparkSession, sf: str) -> DataFrame:
    totals = op.block_all_reduce(_blocks(spark, sf), width=BLOCK, levels=LEVELS)
    return op.blocks_to_dims(totals, "total", width=BLOCK)


def q_block_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The tree-shaped triple over blocks, a row for each element."""
    blocks = op.block_stats(_emb(spark, sf, ("label", "embedding")), "embedding", "label", BLOCK, loss_scale=1,
                            levels=LEVELS)
    return op.blocks_to_dims(blocks, "grad", width=BLOCK, keep=("loss", "cnt")).select("dim", "grad", "loss", "cnt")


def _given_weights(spark, sf):
    """The elements of the embedding of the least id."""
    emb = _emb(spark, sf)
    first = emb.agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select(F.posexplode("embedding").alias("dim", "w")).select("dim", F.col("w").cast("double").alias("w"))


def q_gd_step_given(spark: SparkSession, sf: str) -> DataFrame:
    return op.gd_step(op.all_reduce(_long(spark, sf)), LR, WORKERS, EMBEDDING_SCALE, w0=_given_weights(spark, sf))


def q_gd_weight_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two iterations from given weights, as versions of a weight table joined by block."""
    table = op.WeightTable(spark, width=BLOCK)
    table.write_dims(0, _given_weights(spark, sf))
    totals = op.block_all_reduce(_blocks(spark, sf), width=BLOCK)
    op.descend(table, lambda version, weights: totals, LR, WORKERS, 2)
    return table.history()


def q_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Exact power sums of each user's cents, as a user-defined aggregate."""
    found = op.aggregate_by_key(_cents(src.events(spark, sf, ["user_id", "value"])), "user_id", ["c"], op.Moments())
    return found.select("user_id", "cnt", *[F.col(f"s{k}").cast("double").alias(f"s{k}") for k in range(1, 5)])


def q_largest_values(spark: SparkSession, sf: str) -> DataFrame:
    """Each event type's three largest amounts and how often they occur, as a user-defined aggregate."""
    cents = src.events(spark, sf, ["event_type", "value"]).select("event_type", to_fixed(checked("value"), CENTS).alias("c"))
    found = op.aggregate_by_key(cents, "event_type", ["c"], op.Largest(3))
    pairs = F.zip_with(F.col("largest").cast("array<string>"), F.col("times").cast("array<string>"),
                       lambda v, n: F.concat(v, F.lit(":"), n))
    return found.select("event_type", F.array_join(pairs, ",").alias("largest"))


def q_partition_function(spark: SparkSession, sf: str) -> DataFrame:
    """A partition function, its sum by worker and the join of both, on one exchange."""
    rows = _emb(spark, sf).select("vec_id", worker_of("vec_id", WORKERS).alias("worker"), "embedding")
    scored = op.with_function(rows, op.position_weighted(EMBEDDING_SCALE), ["embedding"], "long", "score")
    laid_out = op.laid_out(scored.select("vec_id", "worker", "score"), ["worker"], WORKERS)
    return op.with_totals(laid_out, ["worker"], {
        "worker_total": lambda w: exact_sum_over("score", w), "worker_rows": lambda w: F.count(F.lit(1)).over(w)})


def q_libsvm_file(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a LibSVM file, read back by path in byte ranges."""
    path = scratch_path(spark, "libsvm")
    src.libsvm_lines(_emb(spark, sf, ("label", "embedding")), features="embedding").write.text(path)
    back = src.load_files(spark, src.LibSVMSource, path, SPLIT_BYTES)
    cells = back.select("label", F.posexplode_outer(F.arrays_zip("indices", "values")).alias("pos", "e"))
    return cells.groupBy("label").agg(
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("cnt"),  # a row's first entry, or none
        F.coalesce(exact_sum(to_fixed("e.values")), F.lit(0)).alias("total"))


def q_dense_text_file(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a dense text matrix, read back by path in byte ranges."""
    path = scratch_path(spark, "dense")
    src.write_dense_text(_emb(spark, sf, ("embedding",)), path, "embedding")
    back = src.load_files(spark, src.DenseSource, path, SPLIT_BYTES)
    return op.all_reduce(back.select(F.posexplode("vec").alias("dim", "x")).select("dim", to_fixed("x").alias("g")))


def q_sparse_all_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse ML vectors of the elements whose fixed point is a multiple of 3, read from a LibSVM file."""
    thin = _emb(spark, sf, ("label", "embedding")).withColumn("embedding", F.transform(
        F.col("embedding").cast("array<double>"), lambda x: F.when(F.pmod(to_fixed(x), F.lit(3)) == 0, x).otherwise(0.0)))
    path = scratch_path(spark, "sparse")
    src.libsvm_lines(thin, features="embedding").write.text(path)
    return op.sparse_all_reduce(src.read_libsvm(spark, path, MLP_LAYERS[0]))


def q_exact_split(spark: SparkSession, sf: str) -> DataFrame:
    return op.exact_split(_emb(spark, sf, ("vec_id",)), "vec_id", SPLIT)


def q_materialise(spark: SparkSession, sf: str) -> DataFrame:
    """The cells, stored with a manifest, taken again by a second call, and their digest."""
    path = scratch_path(spark, "materialised")
    op.materialise(_long(spark, sf), path)
    return op.fingerprint(op.materialise(_long(spark, sf), path).df)


def q_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    lab = src.labels(spark, sf, ["quality", "toxic"])
    return op.accuracy(lab.select(F.col("quality").alias("prediction"),
                                  (F.lit(1) - F.col("toxic")).alias("label")))


def q_map_partitions_sum(spark: SparkSession, sf: str) -> DataFrame:
    return op.map_partitions_sum(_emb(spark, sf), "embedding", "vec_id", WORKERS)


def q_cache_count(spark: SparkSession, sf: str) -> DataFrame:
    stored, count = op.cache_count(src.load(spark, sf, "embeddings"))
    stored.unpersist()
    return spark.createDataFrame([(count,)], "cnt long")


# --------------------------------------------------------------------------- oracle SQL

# Every worker with every element that any worker has.
GRID = BASE + """
, pairs as (select cast(w as int) as worker, dim from (select distinct dim from local), unnest(range(8)) as t(w)),
grid as (select worker, dim, coalesce(g, 0) as g from pairs left join local using (worker, dim))
"""

def _ls_fit_sql() -> str:
    """The iterations of the fit written out: errors per row, gradient per element, next weights."""
    ctes = [f"""
with x as (
  select vec_id, cast(unnest(range(len(embedding))) as int) as dim,
         cast(floor(cast(unnest(embedding) as double) * {LS_SCALE} + 0.5) as bigint) as x,
         cast(floor(cast(label as double) * {LS_SCALE ** 2} + 0.5) as bigint) as y
  from embeddings),
n as (select cast(count(*) as double) * {LS_SCALE}::double * {LS_SCALE}::double as n from embeddings),
w0 as (select distinct dim, cast(0 as bigint) as w from x)"""]
    for k in range(1, LS_ITERATIONS + 1):
        ctes.append(f"""
e{k} as (select vec_id, cast(sum(x * w) as bigint) - any_value(y) as err
       from x join w{k - 1} using (dim) group by vec_id),
g{k} as (select dim, cast(sum(cast(x as hugeint) * err) as double) as g
       from x join e{k} using (vec_id) group by dim),
w{k} as (select dim, cast(floor(cast(w as double) - {LS_LR}::double * (g / n) + 0.5) as bigint) as w
       from g{k} join w{k - 1} using (dim), n)""")
    last = " union all ".join(f"select cast({k} as int) as iter, dim, cast(w as double) / {LS_SCALE}::double as w "
                              f"from w{k}" for k in range(1, LS_ITERATIONS + 1))
    return ",".join(ctes) + "\n" + last


SQL = {
    "matrix_long": BASE + "select worker, dim, g from long",
    "range_source": """
select u.user_id, count(e.user_id) as cnt
from (select unnest(range(min(user_id), max(user_id) + 1)) as user_id from events) u
left join events e on e.user_id = u.user_id group by u.user_id""",
    "libsvm_source": """
with r as (
  select label,
         (select sum(cast(floor(cast(x as double) * 1e6 + 0.5) as bigint))
          from unnest(embedding) as t(x)) as row_total
  from embeddings)
select cast(label as double) as label, count(*) as cnt, cast(sum(row_total) as bigint) as total
from r group by 1""",
    "dense_text_source": SQL_TOTALS,
    "event_gradients": f"""
select cast(cast(ts as date) - date '1970-01-01' as int) as iter,
       cast(((user_id % 8) + 8) % 8 as int) as worker, event_type,
       cast(sum({SQL_CENTS}) as bigint) as g
from events group by all""",
    "matrix_pivot": BASE + """
select worker, cast(count(*) as int) as n, string_agg(cast(g as varchar), ', ' order by dim) as line
from local group by worker""",
    "scatter_reduce": GRID + """
select worker, dim, cast((worker - dim % 8 + 8) % 8 as int) as ring_pos,
       cast(sum(g) over (partition by dim order by (worker - dim % 8 + 8) % 8
                         rows between unbounded preceding and current row) as bigint) as partial
from grid""",
    "group_scatter_reduce": GRID + """
, r as (select cast(worker // 4 as int) as grp, worker, dim,
               cast((worker % 4 - dim % 4 + 4) % 4 as int) as ring_pos, g from grid)
select grp, worker, dim, ring_pos,
       cast(sum(g) over (partition by grp, dim order by ring_pos
                         rows between unbounded preceding and current row) as bigint) as partial
from r""",
    "all_gather": GRID + "select worker, dim, cast(sum(g) over (partition by dim) as bigint) as total from grid",
    "cross_group_merge": GRID + """
select cast(worker // 4 as int) as grp, worker, dim, cast(sum(g) over (partition by dim) as bigint) as total
from grid""",
    "keyed_sum_default": f"""
with k as (select distinct user_id from events where user_id is not null),
p as (select user_id, cast(sum({SQL_CENTS}) as bigint) as total
      from events where event_type = 'purchase' group by user_id)
select k.user_id, cast(coalesce(p.total, 0) as bigint) as total from k left join p on k.user_id = p.user_id""",
    "assemble_vector": BASE + "select worker, dim, cast(g as double) / 1e6 as v from local",
    "keyed_sum": f"select user_id, cast(sum({SQL_CENTS}) as bigint) as total from events group by user_id",
    "hierarchical_all_reduce": BASE + """
, gt as (select cast(worker // 4 as int) as grp, dim, cast(sum(g) as bigint) as grp_total
         from local group by all)
select grp, dim, grp_total, cast(sum(grp_total) over (partition by dim) as bigint) as total from gt""",
    "keyed_set": """
select user_id, value from (
  select user_id, value,
         row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from events) where rn = 1""",
    "all_reduce_sum": SQL_TOTALS,
    "group_all_gather": GRID + """
select cast(worker // 4 as int) as grp, worker, dim,
       cast(sum(g) over (partition by worker // 4, dim) as bigint) as grp_total
from grid""",
    "gd_step": BASE + """
select dim, 1.0::double - 0.2::double * (cast(sum(g) as double) / 1e6) / 8.0::double as w
from long group by dim""",
    "tree_stats": f"""
select cast(sum(c) as bigint) as grad, cast(sum(cast(c as hugeint) * c) as double) as loss,
       count(*) as cnt
from (select {SQL_CENTS} as c from events)""",
    "vector_stats": BASE + """
select dim, cast(sum(g) as bigint) as total, cast(sum(cast(g as hugeint) * g) as double) as sq,
       count(*) as cnt
from long group by dim""",
    "gradient_stats": BASE + """
select dim, cast(sum(g) as bigint) as grad, (select cast(sum(label) as double) from embeddings) as loss,
       (select count(*) from embeddings) as cnt
from long group by dim""",
    "gd_trajectory": f"""
with cells as (
  select cast(cast(ts as date) - date '1970-01-01' as int) as iter,
         cast(((user_id % 8) + 8) % 8 as int) as worker, event_type,
         cast(sum({SQL_CENTS}) as bigint) as g
  from events group by all),
t as (select iter, event_type, cast(sum(g) as bigint) as total from cells group by all)
select iter, event_type,
       1.0::double - 0.2::double * (cast(sum(total) over (partition by event_type order by iter
                rows between unbounded preceding and current row) as double) / 800.0::double) as w
from t""",
    "least_squares_gradient": """
with x as (
  select cast(floor(l_quantity + 0.5) as bigint) as x0,
         cast(floor(l_discount * 100 + 0.5) as bigint) as x1,
         cast(floor(l_tax * 100 + 0.5) as bigint) as x2,
         cast(1 as bigint) as x3,
         cast(floor(l_extendedprice + 0.5) as bigint) as y
  from lineitem),
e as (select x0, x1, x2, x3, x0 + x1 + x2 + x3 - y as err from x)
select cast(sum(cast(x0 as hugeint) * err) as double) as g_quantity,
       cast(sum(cast(x1 as hugeint) * err) as double) as g_discount,
       cast(sum(cast(x2 as hugeint) * err) as double) as g_tax,
       cast(sum(cast(x3 as hugeint) * err) as double) as g_bias,
       cast(sum(cast(err as hugeint) * err) as double) as sse, count(*) as cnt
from e""",
    "least_squares_fit": _ls_fit_sql(),
    "mlp_input": f"""
with s as (
  select vec_id, c, (select coalesce(sum(cast(floor(cast(x as double) * 1e6 + 0.5) as bigint)), 0)
                     from (select unnest(embedding) as x, unnest(range(len(embedding))) as i)
                     where i % 3 = c) as total
  from embeddings, unnest(range(3)) as t(c))
select vec_id,
       case when cast('0x' || substr(md5(cast(vec_id as varchar)), 1, 8) as bigint) % 100 < {TRAIN_PERCENT}
            then 'train' else 'test' end as split,
       cast(arg_min(c, (-total, c)) as double) as label
from s group by vec_id""",
    "hash_split": f"""
select vec_id,
       case when cast('0x' || substr(md5(cast(vec_id as varchar)), 1, 8) as bigint) % 100 < {TRAIN_PERCENT}
            then 'train' else 'test' end as split
from embeddings""",
    "accuracy": """
select cast(sum(case when quality = 1 - toxic then 1 else 0 end) as double) / count(*) as accuracy,
       count(*) as cnt
from labels""",
    "map_partitions_sum": SQL_TOTALS,
    "cache_count": "select count(*) as cnt from embeddings",
}
SQL["block_all_reduce"] = SQL["dense_text_file"] = SQL_TOTALS
SQL["block_stats"] = SQL["gradient_stats"]
SQL["libsvm_file"] = SQL["libsvm_source"]
SQL["gd_step_given"] = BASE + """
, w0 as (select cast(unnest(range(len(e))) as int) as dim, cast(unnest(e) as double) as w
         from (select arg_min(embedding, vec_id) as e from embeddings))
select dim, any_value(w) - 0.2::double * (cast(sum(g) as double) / 1e6) / 8.0::double as w
from long join w0 using (dim) group by dim"""
SQL["gd_weight_table"] = BASE + """
, t as (select dim, cast(sum(g) as double) / 1e6 as t from long group by dim),
v0 as (select cast(unnest(range(len(e))) as int) as dim, cast(unnest(e) as double) as w
       from (select arg_min(embedding, vec_id) as e from embeddings)),
v1 as (select dim, w - 0.2::double * t / 8.0::double as w from v0 join t using (dim)),
v2 as (select dim, w - 0.2::double * t / 8.0::double as w from v1 join t using (dim))
select cast(0 as int) as version, dim, w from v0 union all select 1, dim, w from v1 union all select 2, dim, w from v2"""
SQL["moments"] = f"""
select user_id, count(*) as cnt, cast(sum(c) as double) as s1, cast(sum(c * c) as double) as s2,
       cast(sum(c * c * c) as double) as s3, cast(sum(c * c * c * c) as double) as s4
from (select user_id, cast({SQL_CENTS} as hugeint) as c from events) group by user_id"""
SQL["largest_values"] = f"""
select event_type, string_agg(c || ':' || n, ',' order by c desc) as largest from (
  select event_type, c, count(*) as n, row_number() over (partition by event_type order by c desc) as r
  from (select event_type, {SQL_CENTS} as c from events) group by event_type, c)
where r <= 3 group by event_type"""
SQL["partition_function"] = """
with s as (
  select vec_id, cast(((vec_id % 8) + 8) % 8 as int) as worker,
         cast(list_sum(list_transform(range(1, len(embedding) + 1), lambda i:
              i * cast(floor(cast(embedding[i] as double) * 1e6 + 0.5) as bigint))) as bigint) as score
  from embeddings)
select vec_id, worker, score, cast(sum(score) over w as bigint) as worker_total, count(*) over w as worker_rows
from s window w as (partition by worker)"""
SQL["sparse_all_reduce"] = BASE + """
, x as (select cast(unnest(range(len(embedding))) as int) as dim, cast(unnest(embedding) as double) as x from embeddings)
select dim, cast(sum(cast(floor(x * 1e6 + 0.5) as bigint)) as bigint) as total, count(*) as support
from x where x <> 0 and cast(floor(x * 1e6 + 0.5) as bigint) % 3 = 0 group by dim"""
SQL["exact_split"] = """
with h as (select vec_id, row_number() over (order by cast('0x' || substr(md5(cast(vec_id as varchar)), 1, 15) as bigint),
                                             vec_id) as r, count(*) over () as n from embeddings)
select vec_id, case when r <= floor(0.8::double / 1.0::double * n + 0.5) then 'train'
                    when r <= floor((0.8::double + 0.05::double) / 1.0::double * n + 0.5) then 'check'
                    else 'test' end as split
from h"""
SQL["materialise"] = BASE + """
select count(*) as cnt, cast(sum(cast('0x' || substr(md5(worker || '|' || dim || '|' || g), 1, 15) as bigint)) as varchar)
       as digest
from long"""


def _mlp_forward_sql() -> str:
    """The layers written out: a weighted sum and its sigmoid for each unit, then the first largest."""
    x = "list_transform(embedding, lambda v: cast(v as double))"
    last = len(MLP_LAYERS) - 2
    ctes = [f"with l0 as (select vec_id, {x} as x from embeddings)"]
    for layer, (inputs, units) in enumerate(zip(MLP_LAYERS, MLP_LAYERS[1:])):
        w = f"((31 * {layer} + 17 * u + 7 * (i - 1)) % 23 - 11) / 10.0::double"
        z = (f"list_sum(list_transform(range(1, {inputs + 2}), lambda i: {w} * "
             f"(case when i <= {inputs} then x[i] else 1.0::double end)))")
        out = z if layer == last else f"1.0::double / (1.0::double + exp(-{z}))"
        ctes.append(f"l{layer + 1} as (select vec_id, list_transform(range(0, {units}), lambda u: {out}) as x from l{layer})")
    return (", ".join(ctes) + f" select vec_id, cast(list_position(x, list_max(x)) - 1 as double) as prediction "
            f"from l{last + 1}")


SQL["mlp_forward"] = _mlp_forward_sql()
SQL["hierarchical_all_reduce_rollup"] = SQL["hierarchical_all_reduce"]


CATALOGUE: list[Query] = [
    Query("matrix_long", q_matrix_long, SQL["matrix_long"], ("O01", "O08")),
    Query("range_source", q_range_source, SQL["range_source"], ("O02",)),
    Query("libsvm_source", q_libsvm_source, SQL["libsvm_source"], ("O03",)),
    Query("dense_text_source", q_dense_text_source, SQL["dense_text_source"], ("O04",)),
    Query("event_gradients", q_event_gradients, SQL["event_gradients"], ("O05",)),
    Query("matrix_pivot", q_matrix_pivot, SQL["matrix_pivot"], ("O06",)),
    Query("scatter_reduce", q_scatter_reduce, SQL["scatter_reduce"], ("O18",)),
    Query("group_scatter_reduce", q_group_scatter_reduce, SQL["group_scatter_reduce"],
          ("O10", "O21")),
    Query("all_gather", q_all_gather, SQL["all_gather"], ("O11", "O19")),
    Query("keyed_sum_default", q_keyed_sum_default, SQL["keyed_sum_default"], ("O02", "O13")),
    Query("assemble_vector", q_assemble_vector, SQL["assemble_vector"], ("O14",)),
    Query("keyed_sum", q_keyed_sum, SQL["keyed_sum"], ("O16", "O37")),
    Query("hierarchical_all_reduce", q_hierarchical_all_reduce, SQL["hierarchical_all_reduce"],
          ("O12", "O22", "O23", "O24")),
    Query("hierarchical_all_reduce_rollup", q_hierarchical_all_reduce_rollup,
          SQL["hierarchical_all_reduce_rollup"], ("O24",)),
    Query("keyed_set", q_keyed_set, SQL["keyed_set"], ("O17",)),
    Query("all_reduce_sum", q_all_reduce_sum, SQL["all_reduce_sum"], ("O16", "O20")),
    Query("group_all_gather", q_group_all_gather, SQL["group_all_gather"], ("O22",)),
    Query("cross_group_merge", q_cross_group_merge, SQL["cross_group_merge"], ("O12", "O23")),
    Query("gd_step", q_gd_step, SQL["gd_step"], ("O15", "O26")),
    Query("tree_stats", q_tree_stats, SQL["tree_stats"], ("O25",)),
    Query("gradient_stats", q_gradient_stats, SQL["gradient_stats"], ("O25",)),
    Query("vector_stats", q_vector_stats, SQL["vector_stats"], ("O25",)),
    Query("gd_trajectory", q_gd_trajectory, SQL["gd_trajectory"], ("O05", "O26", "O27")),
    Query("least_squares_gradient", q_least_squares_gradient, SQL["least_squares_gradient"],
          ("O28",)),
    Query("least_squares_fit", q_least_squares_fit, SQL["least_squares_fit"], ("O28",)),
    Query("hash_split", q_hash_split, SQL["hash_split"], ("O29",)),
    Query("mlp_input", q_mlp_input, SQL["mlp_input"], ("O29", "O30")),
    Query("mlp_fit_predict", q_mlp_fit_predict, None, ("O30", "O31"),
          "a model of floating-point weights; its rows and labels are those of mlp_input"),
    Query("mlp_accuracy", q_mlp_accuracy, None, ("O31", "O32"), "accuracy floor checked in tests"),
    Query("accuracy", q_accuracy, SQL["accuracy"], ("O32",)),
    Query("map_partitions_sum", q_map_partitions_sum, SQL["map_partitions_sum"], ("O33",)),
    Query("cache_count", q_cache_count, SQL["cache_count"], ("O36",)),
    Query("block_all_reduce", q_block_all_reduce, SQL["block_all_reduce"], ("O14", "O20")),
    Query("block_stats", q_block_stats, SQL["block_stats"], ("O14", "O25")),
    Query("gd_step_given", q_gd_step_given, SQL["gd_step_given"], ("O15",)),
    Query("gd_weight_table", q_gd_weight_table, SQL["gd_weight_table"], ("O15", "O27", "O28")),
    Query("moments", q_moments, SQL["moments"], ("O37",)),
    Query("largest_values", q_largest_values, SQL["largest_values"], ("O37",)),
    Query("partition_function", q_partition_function, SQL["partition_function"], ("O33",)),
    Query("libsvm_file", q_libsvm_file, SQL["libsvm_file"], ("O03",)),
    Query("dense_text_file", q_dense_text_file, SQL["dense_text_file"], ("O04",)),
    Query("sparse_all_reduce", q_sparse_all_reduce, SQL["sparse_all_reduce"], ("O03", "O20")),
    Query("exact_split", q_exact_split, SQL["exact_split"], ("O29",)),
    Query("materialise", q_materialise, SQL["materialise"], ("O36",)),
    Query("mlp_forward", q_mlp_forward, SQL["mlp_forward"], ("O31",)),
]

BY_NAME = {q.name: q for q in CATALOGUE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.build for q in CATALOGUE}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in CATALOGUE if q.sql is not None}

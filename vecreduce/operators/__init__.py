"""DataFrame operators: layout, reductions, statistics, training, ML, partitions."""

from .aggregate import Aggregate, Largest, Moments, aggregate_by_key
from .blocks import (block_all_reduce, block_stats, blocks_to_dims, dims_to_blocks, sum_of_blocks, to_blocks)
from .gram import descend_on_gram, gram
from .layout import assemble, explode_vector, local_sums, to_long, with_groups
from .materialise import Materialised, fingerprint, materialise
from .ml import (accuracy, evaluate_accuracy, exact_split, hash_bucket, hash_split, mlp_fit, mlp_forward, mlp_weights,
                 predict, random_split, strided_label, vector_features)
from .preserve import (laid_out, position_weighted, position_weighted_column, with_function, with_totals,
                       write_bucketed)
from .partition import cache_count, map_partitions_sum
from .reduce import (all_gather, all_reduce, cross_group_merge, group_all_gather, group_all_reduce,
                     hierarchical_all_reduce, keyed_set, keyed_sum, merge_groups, scatter_reduce,
                     sparse_all_reduce, with_default)
from .stats import gradient_stats, tree_stats, vector_stats
from .weights import WeightTable, descend, updated
from .train import event_cells, event_gradients, gd_step, gd_trajectory, ls_fit, ls_gradient

__all__ = [
    "Materialised", "fingerprint", "materialise", "exact_split", "mlp_forward", "mlp_weights",
    "laid_out", "position_weighted", "position_weighted_column", "with_function", "with_totals", "write_bucketed",
    "Aggregate", "Largest", "Moments", "aggregate_by_key",
    "block_all_reduce", "block_stats", "blocks_to_dims", "dims_to_blocks", "sum_of_blocks", "to_blocks",
    "descend_on_gram", "gram", "WeightTable", "descend", "updated", "sparse_all_reduce",
    "assemble", "explode_vector", "local_sums", "to_long", "with_groups",
    "accuracy", "evaluate_accuracy", "hash_bucket", "hash_split", "mlp_fit", "predict", "random_split",
    "strided_label", "vector_features",
    "cache_count", "map_partitions_sum",
    "all_gather", "all_reduce", "cross_group_merge", "group_all_gather", "group_all_reduce",
    "hierarchical_all_reduce", "keyed_set", "keyed_sum", "merge_groups", "scatter_reduce",
    "with_default",
    "gradient_stats", "tree_stats", "vector_stats",
    "event_cells", "event_gradients", "gd_step", "gd_trajectory", "ls_fit", "ls_gradient",
]

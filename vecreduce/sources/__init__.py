"""Sources and sinks."""

from .datasource import DenseSource, LibSVMSource, load_files
from .files import (DENSE_SEPARATOR, dense_lines, libsvm_lines, parse_dense, parse_libsvm, read_dense_text, read_libsvm,
                    write_dense_text, write_libsvm)
from .generated import (counting_matrix, key_domain, libsvm_fixture, matrix_literal,
                        range_source, synthetic_gradients)
from .sinks import matrix_rows, show_matrix, to_local, write_parquet
from .tables import TABLES, embeddings, events, labels, lineitem, load, table_path

__all__ = [
    "DenseSource", "LibSVMSource", "load_files",
    "DENSE_SEPARATOR", "dense_lines", "libsvm_lines", "parse_dense", "parse_libsvm", "read_dense_text", "read_libsvm",
    "write_dense_text", "write_libsvm",
    "counting_matrix", "key_domain", "libsvm_fixture", "matrix_literal", "range_source",
    "synthetic_gradients",
    "matrix_rows", "show_matrix", "to_local", "write_parquet",
    "TABLES", "embeddings", "events", "labels", "lineitem", "load", "table_path",
]

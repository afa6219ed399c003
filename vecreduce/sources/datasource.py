"""LibSVM and dense text files as Spark data sources: ``format("vecreduce_libsvm")``.

Files are cut into byte ranges, and a range reads the lines that begin in it.  Every line
is checked; a wrong one fails with its file and byte offset.  Rows are sparse: stored
entries only, counted from 0, and no pass finds the width first.

Files are opened with ``pyarrow.fs``: local and shared folders, HDFS, S3, GCS.  A store
that only Spark's own readers reach is read by ``read_libsvm`` and ``read_dense_text``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SPLIT_BYTES = 64 << 20
_ROWS = 4_096


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines_of(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in ``[start, end)`` of a file, each with its offset."""
    system, inner = filesystem(path)
    with system.open_input_file(inner) as file:
        at = max(0, start - 1)
        file.seek(at)
        rest = b""
        skipping = start > 0  # to the first line that begins at ``start`` or later
        while True:
            block = file.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                if not skipping:
                    if at >= end:
                        return
                    yield at, line
                skipping = False
                at += len(line) + 1
            if not block or (at >= end and not skipping):
                return


def parse_libsvm_line(line: bytes) -> tuple[float, list[int], list[float]]:
    label, *entries = line.split()
    indices, values, before = [], [], 0
    for entry in entries:
        index, value = entry.split(b":")
        if int(index) <= before:
            raise ValueError(f"index {int(index)} after {before}")
        before = int(index)
        indices.append(before - 1)
        values.append(float(value))
    return float(label), indices, values


def parse_dense_line(line: bytes) -> tuple[list[float]]:
    return ([float(v) for v in line.split(b",")],)


class LineReader(DataSourceReader):
    def __init__(self, options: dict, parse, arrow_schema):
        if "path" not in options:
            raise ValueError("vecreduce: load(path) needs a path")
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        if self.split < 1:
            raise ValueError("vecreduce: splitBytes must be positive")
        self.parse, self.arrow_schema = parse, arrow_schema

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = filesystem(self.path)
        found = system.get_file_info(inner)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"vecreduce: no such path: {self.path}")
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[:self.path.index(inner)] if inner in self.path else "file://"
        ranges = []
        for file in sorted(files, key=lambda f: f.path):
            if file.type == fs.FileType.File and not file.base_name.startswith(("_", ".")):
                path = prefix + file.path
                ranges += [ByteRange(path, at, min(at + self.split, file.size)) for at in range(0, file.size, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        import pyarrow as pa

        if not partition.path:
            return
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), self.arrow_schema)], schema=self.arrow_schema)

        for offset, line in lines_of(partition.path, partition.start, partition.end):
            if not line.strip():
                continue
            try:
                rows.append(self.parse(line))
            except ValueError as error:
                raise ValueError(f"vecreduce: {partition.path} at byte {offset}: {error}") from None
            if len(rows) == _ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class LibSVMSource(DataSource):
    """``(label double, indices array<int>, values array<double>)`` of LibSVM files."""

    @classmethod
    def name(cls) -> str:
        return "vecreduce_libsvm"

    def schema(self) -> str:
        return "label double, indices array<int>, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        import pyarrow as pa
        return LineReader(self.options, parse_libsvm_line, pa.schema([
            ("label", pa.float64()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))


class DenseSource(DataSource):
    """``(vec array<double>)`` of dense text matrices."""

    @classmethod
    def name(cls) -> str:
        return "vecreduce_dense"

    def schema(self) -> str:
        return "vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        import pyarrow as pa
        return LineReader(self.options, parse_dense_line, pa.schema([("vec", pa.list_(pa.float64()))]))


def load_files(spark: SparkSession, source: type[DataSource], path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of the files at ``path``, a file or a folder, in ranges of ``split_bytes``."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("splitBytes", str(split_bytes)).load(path)

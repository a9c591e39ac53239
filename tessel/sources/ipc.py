"""Arrow IPC files: writing, full and narrow scans, and a data source that maps files into memory on the executors."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def write_ipc(df: DataFrame, folder: str, batch_rows: int = 65_536) -> None:
    """One IPC file for each partition, written by its task under a temporary name and then renamed."""
    os.makedirs(folder, exist_ok=True)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = os.path.join(folder, f"part-{part:05d}.arrow")
        rows = 0
        with pa.OSFile(f"{path}.{os.getpid()}.tmp", "wb") as sink, pa.ipc.new_file(sink, schema) as w:
            for b in batches:
                for start in range(0, b.num_rows, batch_rows):
                    w.write_batch(b.slice(start, batch_rows).cast(schema) if b.schema != schema else b.slice(start, batch_rows))
                rows += b.num_rows
        os.replace(f"{path}.{os.getpid()}.tmp", path)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").collect()


def read_ipc_table(path: str, columns: list[str] | None = None) -> pa.Table:
    """A file as a table over the mapped file, without copies; with ``columns``, only these."""
    source = pa.memory_map(path)
    options = None
    if columns is not None:
        names = pa.ipc.open_file(source).schema.names
        options = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns])
    t = pa.ipc.open_file(source, options=options).read_all()
    return t if columns is None else t.select(columns)


def mapped_int32(path: str) -> tuple[pa.ChunkedArray, bool]:
    """The single int column of a file, and whether its buffers lie in the mapped file, that is, nothing was copied."""
    before = pa.total_allocated_bytes()
    t = pa.ipc.open_file(pa.memory_map(path)).read_all()
    copied = pa.total_allocated_bytes() - before
    if t.num_columns != 1 or t.schema.field(0).type != pa.int32():
        raise TypeError("the file must have one int32 column")
    return t.column(0), copied < max(t.nbytes, 1)


def _files(path: str) -> list[str]:
    return [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(glob.escape(path), "*.arrow")))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.columns = options["path"], options.get("columns")

    def partitions(self):
        return [_Part(p) for p in _files(self.path)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        yield from read_ipc_table(partition.path, self.columns.split(",") if self.columns else None).to_batches()


class ArrowIpcSource(DataSource):
    """``spark.read.format("tessel_ipc").load(path)``; option ``columns`` reads only these."""

    @classmethod
    def name(cls) -> str:
        return "tessel_ipc"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        path = _files(self.options["path"])[0]
        columns = self.options.get("columns")
        return from_arrow_schema(read_ipc_table(path, columns.split(",") if columns else None).schema)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_ipc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format("tessel_ipc")
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path)

"""Tables in memory: Arrow data as a table, and as a Python data source that reads only the columns asked for."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scale import shared_path
from .ipc import read_ipc


def memory_table(spark: SparkSession, data: pa.Table | list[pa.RecordBatch], name: str | None = None, schema=None) -> DataFrame:
    """A DataFrame over Arrow data, under a contract's schema if one is given, and as a view if it has a name."""
    t = data if isinstance(data, pa.Table) else pa.Table.from_batches(data)
    df = spark.createDataFrame(t, schema=schema) if schema is not None else spark.createDataFrame(t)
    if name:
        df.createOrReplaceTempView(name)
    return df


def packed(data: pa.Table) -> str:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema) as w:
        w.write_table(data)
    return base64.b64encode(sink.getvalue()).decode()


class MemoryProvider:
    """A table of Arrow batches that is scanned by columns: a scan reads the columns asked for and no others.

    The batches are kept once as a mapped IPC file in the session's shared folder, so data does not travel in plans; filters
    and limits are left to the engine.
    """

    def __init__(self, spark: SparkSession, batches: list[pa.RecordBatch], schema: pa.Schema | None = None):
        schema = schema or batches[0].schema
        self.spark, self.schema, self.path = spark, schema, os.path.join(shared_path(spark), "table.arrow")
        with pa.OSFile(self.path, "wb") as sink, pa.ipc.new_file(sink, schema) as w:
            for batch in batches:
                w.write_batch(batch)

    def scan(self, columns: list[str] | None = None) -> DataFrame:
        """The columns in the order asked for, or all; an unknown one is an error."""
        unknown = set(columns or ()) - set(self.schema.names)
        if unknown:
            raise KeyError(f"no such column: {', '.join(sorted(unknown))}")
        return read_ipc(self.spark, self.path, columns)


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.table = pa.ipc.open_stream(base64.b64decode(options["data"])).read_all()
        columns = options.get("columns")
        if columns:
            self.table = self.table.select(columns.split(","))
        self.parts = max(1, int(options.get("parts", "1")))

    def partitions(self):
        return [_Part(k) for k in range(self.parts)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        size = -(-self.table.num_rows // self.parts) or 1
        yield from self.table.slice(partition.number * size, size).to_batches()


class MemorySource(DataSource):
    """``spark.read.format("tessel_memory").option("data", packed(table))``; ``columns`` names those to read, filters are left
    to the engine.  For small tables: the data travels in the plan."""

    @classmethod
    def name(cls) -> str:
        return "tessel_memory"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_Reader(self.options).table.schema)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register_sources(spark: SparkSession) -> None:
    from .counted import CountedStream
    from .ipc import ArrowIpcSource

    for source in (MemorySource, ArrowIpcSource, CountedStream):
        spark.dataSource.register(source)

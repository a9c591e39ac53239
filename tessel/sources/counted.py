"""A stream of numbered rows in counted batches that can be read again from any batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _Batch(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceStreamReader):
    """Offsets count batches; every read of the same offsets gives the same rows."""

    def __init__(self, options):
        self.batches, self.rows = int(options.get("batches", "32")), int(options.get("rows", "8"))
        self.at = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + 8, self.batches)
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["batch"])
        return [_Batch(k, k + 1) for k in range(start["batch"], end["batch"])]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        ids = range(partition.first * self.rows, partition.last * self.rows)
        yield pa.RecordBatch.from_arrays([pa.array([partition.first] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["batch", "id"])


class CountedStream(DataSource):
    """``spark.readStream.format("tessel_counted")`` with ``batches`` batches of ``rows`` rows each."""

    @classmethod
    def name(cls) -> str:
        return "tessel_counted"

    def schema(self) -> str:
        return "batch bigint, id bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)

"""Results batch by batch on the driver, in order, one partition in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row


def rows_of(df: DataFrame, prefetch: bool = False) -> Iterator[Row]:
    """Rows in the order of the result; stopping early leaves later partitions uncomputed."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


def batches_of(df: DataFrame, rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``rows`` rows, all under one schema; the last may be smaller, no rows give no batch.

    Rows stay in Arrow form: each task packs its batches, and the driver unpacks them one after the other.
    """
    if rows <= 0:
        raise ValueError("a batch needs at least one row")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    held, n = [], 0
    for row in df.mapInArrow(pack, "data binary").toLocalIterator():
        part = pa.ipc.open_stream(row.data).read_all().cast(schema)
        while n + part.num_rows >= rows:
            take = rows - n
            yield pa.concat_tables([*held, part.slice(0, take)]).combine_chunks().to_batches()[0]
            held, n, part = [], 0, part.slice(take)
        if part.num_rows:
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.concat_tables(held).combine_chunks().to_batches()[0]

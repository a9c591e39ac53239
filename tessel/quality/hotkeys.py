"""Per-key results where a few keys hold most rows, by dense accumulator arrays.

Rows are taken in splits of equal length.  Each split dictionary-encodes its keys and reduces its rows into dense arrays by
``bincount`` and scatter-min/max, so a hot key leaves a split as one slot.  All keys belong to one dictionary that is cut
into blocks by the hash of the key; what a split sends to a block is one row with its keys and their array slots.  The
arrays of a block are summed slot by slot over the block's dictionary.  There are so many blocks that one has about
``BLOCK_KEYS`` keys, and a task holds one block at a time, so its memory stays the same as keys and rows grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import parts_for, shuffle_parts

#: Rows of a split, and keys of a block, about.
SPLIT_ROWS = 1_000_000
BLOCK_KEYS = 32_768

_SENT = pa.schema([("block", pa.int64()), ("field", pa.int32()), ("keys", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])
_SENT_DDL = "block bigint, field int, keys array<string>, n array<bigint>, first array<bigint>, last array<bigint>"
_RESULT_DDL = "field string, key_value string, n_rows bigint, first_at timestamp_ntz, last_at timestamp_ntz"
#: Stands for no time.
_NONE = np.iinfo(np.int64).max


def _scatter(codes: np.ndarray, slots: int, n: np.ndarray | None, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense arrays of count, least and greatest over ``codes``."""
    if n is None:
        counts = np.bincount(codes, minlength=slots).astype(np.int64)
    else:
        counts = np.zeros(slots, np.int64)
        np.add.at(counts, codes, n)
    low, high = np.full(slots, _NONE), np.full(slots, -_NONE)
    np.minimum.at(low, codes, first)
    np.maximum.at(high, codes, last)
    return counts, low, high


def _stamps(values: np.ndarray, none: int) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == none).cast(pa.timestamp("us"))


def _reduce_splits(n_fields: int, blocks: int, split_rows: int):
    from pandas.util import hash_array

    def reduced(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The arrays of one split, a row for each field and block."""
        t = pa.Table.from_batches(batches).combine_chunks()
        at = t.column(n_fields).combine_chunks().cast(pa.timestamp("us")).cast(pa.int64())
        low, high = (pc.fill_null(at, none).to_numpy(zero_copy_only=False) for none in (_NONE, -_NONE))
        for k in range(n_fields):
            codes = t.column(k).combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            some = codes.indices.is_valid().to_numpy(zero_copy_only=False)
            index = pc.fill_null(codes.indices, 0).to_numpy(zero_copy_only=False)[some]
            keys = codes.dictionary.cast(pa.string())
            if not len(index):
                continue
            counts, first, last = _scatter(index, len(keys), None, low[some], high[some])
            block = (hash_array(keys.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            own, starts = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(starts, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(order)), *(pa.array(a[order]) for a in (counts, first, last)))]
            yield from pa.Table.from_arrays([pa.array(own), pa.array(np.full(len(own), k, np.int32)), *lists], schema=_SENT).to_batches(max_chunksize=1_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while rows + batch.num_rows >= split_rows:
                held.append(batch.slice(0, split_rows - rows))
                batch = batch.slice(split_rows - rows)
                yield from reduced(held)
                held, rows = [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield from reduced(held)

    return run


def _sum_blocks(fields: list[str], block_keys: int):
    def summed(parts: list[tuple]) -> tuple:
        """One set of arrays over the dictionary of the keys of ``parts``."""
        codes = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        index = codes.indices.to_numpy(zero_copy_only=False)
        return codes.dictionary, *_scatter(index, len(codes.dictionary), *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)))

    def result(field: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, counts, first, last = summed(parts)
        name = pa.array([fields[field]], pa.string()).take(pa.array(np.zeros(len(keys), np.int64)))
        columns = [name, keys, pa.array(counts), _stamps(first, _NONE), _stamps(last, -_NONE)]
        yield from pa.Table.from_arrays(columns, names=["field", "key_value", "n_rows", "first_at", "last_at"]).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0
        for batch in batches:
            block, field = (batch.column(k).to_numpy() for k in (0, 1))
            for r in range(batch.num_rows):
                if (block[r], field[r]) != now:
                    if parts:
                        yield from result(now[1], parts)
                    now, parts, held = (block[r], field[r]), [], 0
                part = batch.column(2)[r].values, *(batch.column(k)[r].values.to_numpy() for k in (3, 4, 5))
                parts.append(part)
                held += len(part[0])
                if held > 4 * block_keys and held > 2 * len(parts[0][0]):
                    parts = [summed(parts)]
                    held = len(parts[0][0])
        if parts:
            yield from result(now[1], parts)

    return run


def per_key(df: DataFrame, fields: list[str], at: str) -> DataFrame:
    """``field``, ``key_value`` (as text), ``n_rows``, ``first_at`` and ``last_at`` of each non-null key of each field.

    Null keys have no result, null times do not count for the range; repeated rows count as stored; an empty
    table gives no row.  Columns other than ``fields`` and ``at`` are not read.
    """
    found = df.agg(*(F.approx_count_distinct(f) for f in fields)).first()
    parts = shuffle_parts(df.sparkSession)
    blocks = parts_for(max(found), BLOCK_KEYS, parts)
    rows = df.select(*(F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields)), F.col(at).cast("timestamp_ntz").alias("_at"))
    sent = rows.mapInArrow(_reduce_splits(len(fields), blocks, SPLIT_ROWS), _SENT_DDL)
    met = sent.repartition(min(parts, len(fields) * blocks), "block", "field").sortWithinPartitions("block", "field")
    return met.mapInArrow(_sum_blocks(fields, BLOCK_KEYS), _RESULT_DDL)


def heavy_keys(results: DataFrame, total_rows: int, share: float = 0.01) -> DataFrame:
    """``field`` and ``key_value`` of the keys that hold at least ``share`` of ``total_rows`` rows."""
    if not total_rows:
        return results.select("field", "key_value").limit(0)
    return results.where(F.col("n_rows") >= F.lit(float(share)) * F.lit(total_rows)).select("field", "key_value")

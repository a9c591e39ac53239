"""Readers and writers beyond what the session has built in."""

from .csv import ingest_csv, orders_csv, select_column, shipments_csv, split_records
from .delta import overwrite_delta, read_delta
from .ipc import ArrowIpcSource, read_ipc, write_ipc
from .memory import MemorySource, memory_table, register_sources
from .parquet import footers, layout_report, read_ingest, write_partitioned, write_single

__all__ = [
    "ArrowIpcSource", "MemorySource", "footers", "ingest_csv", "layout_report", "memory_table", "orders_csv", "overwrite_delta", "read_delta", "read_ingest",
    "read_ipc", "register_sources", "select_column", "shipments_csv", "split_records", "write_ipc", "write_partitioned", "write_single",
]

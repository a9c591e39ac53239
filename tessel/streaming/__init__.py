"""Flow of rows: batch-wise reads, byte budgets, cancellation, bounded ingestion, and event streams."""

from .batches import batches_of, rows_of
from .bounded import BoundedConfig, BoundedReport, run_bounded, run_bounded_store
from .budget import BatchGrowthExceedsBudget, BatchTooLarge, ByteBudget, ByteChargeOverflow
from .cancel import Cancelled, CancellationToken
from .events import event_windows, ingest_stream, session_windows, stateful_totals

__all__ = [
    "BatchGrowthExceedsBudget", "BatchTooLarge", "BoundedConfig", "BoundedReport", "ByteBudget", "ByteChargeOverflow", "CancellationToken", "Cancelled",
    "batches_of", "event_windows", "ingest_stream", "rows_of", "run_bounded", "run_bounded_store", "session_windows", "stateful_totals",
]

"""A byte budget for the batches of a task.

Each task checks its own batches: what a batch holds is charged while the transform works on it and given back after it.
The largest charge and the number of batches go to accumulators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..contracts.validate import _plain

MOST = (1 << 63) - 1


class BudgetError(RuntimeError):
    def __init__(self, text: str, size: int, limit: int):
        self.size, self.limit = size, limit
        super().__init__(f"{type(self).__name__}: {text}: {size} bytes, limit {limit}")


class BatchTooLarge(BudgetError):
    """A batch alone is over the limit."""


class BatchGrowthExceedsBudget(BudgetError):
    """A transform made its batch larger than the budget has left."""


class ByteChargeOverflow(BudgetError):
    """Charges do not fit 64 bits."""


def batch_bytes(batch: pa.RecordBatch) -> int:
    """Bytes a batch holds; buffers shared by slices count for each slice."""
    return batch.nbytes


@dataclass
class ByteBudget:
    """Charges against a limit.  Nothing waits: a charge fits or raises."""

    limit: int
    current: int = 0
    peak: int = 0

    def admit(self, size: int) -> None:
        if size > self.limit:
            raise BatchTooLarge("batch", size, self.limit)
        self._add(size, BatchTooLarge)

    def grow(self, before: int, after: int) -> None:
        """After a transform; a smaller batch keeps its first charge."""
        if after > before:
            self._add(after - before, BatchGrowthExceedsBudget)

    def _add(self, size: int, error: type[BudgetError]) -> None:
        total = self.current + size
        if total > MOST:
            raise ByteChargeOverflow("charge", total, MOST)
        if total > self.limit:
            raise error("charge", total, self.limit)
        self.current = total
        self.peak = max(self.peak, total)

    def release(self, size: int) -> None:
        self.current -= size


def budgeted(df: DataFrame, transform: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, limit: int) -> tuple[DataFrame, dict]:
    """``transform`` applied to every Arrow batch under a budget of ``limit`` bytes for each task.

    Values of ``schema`` may be null in the result whatever it says, so that a later check sees those that are.
    Also gives accumulators, filled when the result has been computed: ``batches``, ``bytes``, and ``peak`` as a list.
    """
    sc = df.sparkSession.sparkContext
    batches, admitted = sc.accumulator(0), sc.accumulator(0)
    from pyspark.accumulators import AccumulatorParam

    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):  # noqa: N802
            return max(a, b)

    peak = sc.accumulator(0, Largest())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = ByteBudget(limit)
        for batch in source:
            before = batch_bytes(batch)
            budget.admit(before)
            out = transform(batch)
            after = batch_bytes(out)
            budget.grow(before, after)
            batches.add(1)
            admitted.add(before)
            peak.add(budget.peak)
            yield out
            budget.release(max(before, after))

    return df.mapInArrow(run, _plain(schema)), {"batches": batches, "bytes": admitted, "peak": peak}

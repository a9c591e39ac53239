"""Cooperative cancellation."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The run was cancelled; nothing was published after that."""


class CancellationToken:
    """Checked between phases; cancelling also ends the Spark jobs that run under the token."""

    def __init__(self):
        self._event = threading.Event()
        self._tag = f"tessel-{uuid.uuid4().hex}"
        self._sessions: list[SparkSession] = []

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def cancel(self) -> None:
        self._event.set()
        for spark in list(self._sessions):
            spark.sparkContext.cancelJobsWithTag(self._tag)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("cancelled")

    @contextmanager
    def jobs(self, spark: SparkSession):
        """Jobs started inside end when the token is cancelled."""
        self.check()
        sc = spark.sparkContext
        sc.addJobTag(self._tag)
        sc.setInterruptOnCancel(True)
        self._sessions.append(spark)
        try:
            yield
        finally:
            self._sessions.remove(spark)
            sc.removeJobTag(self._tag)

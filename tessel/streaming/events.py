"""Event-time streams over the events table; an addition for users of Structured Streaming.

Each function takes a batch or a streaming DataFrame with ``ts``, ``user_id``, ``event_type`` and ``value``: the same plan serves
both, which is how results are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum for each window and event type; events later than ``late`` are dropped from a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, which end after a ``gap`` without events."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n_events")


def stateful_totals(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Running number of events and total of each user, updated with every trigger, by state in Python."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "total": [total]})

    return (
        _timed(events, late).select("user_id", "value").groupBy("user_id")
        .applyInPandasWithState(update, "user_id bigint, n_events bigint, total double", "n bigint, total double", "update", "NoTimeout")
    )


def ingest_stream(spark: SparkSession, source: str, schema, publish, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Parquet files as they arrive, each micro-batch handed to ``publish(df, batch_id)``; started for what is there now."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

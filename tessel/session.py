"""Session settings in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every profile has: zone, ANSI errors, adaptive plans, Arrow batches; unused checkpoints are removed.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
PROFILES = {
    "default": {},
    "merge_join": {"spark.sql.join.preferSortMergeJoin": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    "no_broadcast": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"},
    "wide_shuffle": {"spark.sql.shuffle.partitions": "4000", "spark.sql.files.maxPartitionBytes": "256m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m"},
}


def session(name: str = "tessel", profile: str = "default", master: str | None = None, **settings: str) -> SparkSession:
    """A session with a profile; ``settings`` win, with ``__`` for dots in names."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**BASE, **PROFILES[profile], **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def use_profile(spark: SparkSession, profile: str) -> None:
    """Sets a profile's settings on a running session."""
    for k, v in PROFILES[profile].items():
        spark.conf.set(k, v)

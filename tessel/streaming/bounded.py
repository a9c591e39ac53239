"""Bounded ingestion: CSV to Parquet in one pass, validated on the way and published only when complete."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..contracts.validate import INGEST, Validator
from ..functions.aggregates import multiset_digest
from ..pipeline import guarded
from ..publish.completed import download_to_temp
from ..publish.manifest import CompletionManifest
from ..publish.publication import publish
from ..publish.staging import publish_dataframe
from ..publish.store import ObjectStore
from ..scale import shared_path
from ..sources.csv import CsvError, first_bad_row, ingest_csv
from .budget import budgeted
from .cancel import CancellationToken

FIELDS = ("id", "name", "note")


@dataclass(frozen=True)
class BoundedConfig:
    """``batch_rows``: rows of an Arrow batch; ``byte_budget``: bytes of batches in flight in a task."""

    batch_rows: int = 10_000
    byte_budget: int = 256 << 20
    compression: str = "zstd"

    def __post_init__(self):
        if self.batch_rows <= 0 or self.byte_budget <= 0:
            raise ValueError("batch_rows and byte_budget must be positive")


@dataclass(frozen=True)
class BoundedReport:
    """``batches`` and ``peak_bytes`` are of the transform, 0 without one."""

    rows: int
    digest: str
    batches: int = 0
    admitted_bytes: int = 0
    peak_bytes: int = 0


def run_bounded(
    spark: SparkSession,
    source: str,
    output: str,
    config: BoundedConfig = BoundedConfig(),
    transform: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    cancel: CancellationToken | None = None,
    publish_to: Callable[[DataFrame, str, Callable[[], None]], None] | None = None,
) -> BoundedReport:
    """Ingests a CSV file into a Parquet folder: one job parses, transforms, validates, digests and writes.

    Nothing is published if a record is malformed, a batch is over the budget, a required value is null, or the token was
    cancelled at any time before the rename; an old output then stays.
    """
    cancel = cancel or CancellationToken()
    cancel.check()
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(config.batch_rows))
    df, counters = ingest_csv(spark, source), None
    if transform:
        df, counters = budgeted(df, transform, INGEST, config.byte_budget)
    df = guarded(df, Validator(INGEST), "Ingest")
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"), multiset_digest(*FIELDS).alias("digest"))
    write = publish_to or (lambda d, path, veto: publish_dataframe(d, path, config.compression, veto))
    try:
        with cancel.jobs(spark):
            write(df, output, cancel.check)
    except Exception as e:
        cancel.check()
        try:
            bad = first_bad_row(source.removeprefix("file://"), len(FIELDS))
        except OSError:
            bad = None
        if bad:
            raise bad from e
        if "MALFORMED" in str(e) or "bad id" in str(e):
            raise CsvError(source, str(e).splitlines()[0]) from e
        raise
    finally:
        spark.conf.set(setting, before)
    got = seen.get
    if counters is None:
        return BoundedReport(got["rows"], got["digest"])
    return BoundedReport(got["rows"], got["digest"], counters["batches"].value, counters["bytes"].value, counters["peak"].value)


def run_bounded_store(
    spark: SparkSession,
    store: ObjectStore,
    input_key: str,
    output_key: str,
    config: BoundedConfig = BoundedConfig(),
    transform: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    cancel: CancellationToken | None = None,
) -> tuple[BoundedReport, CompletionManifest]:
    """The same between keys of a store: the input is one identity of the object, the output one file with its manifest."""
    cancel = cancel or CancellationToken()
    cancel.check()
    folder = shared_path(spark)
    try:
        source, output = os.path.join(folder, "input.csv"), os.path.join(folder, "output")
        os.chmod(folder, 0o755)
        meta = download_to_temp(store, input_key, source)
        cancel.check()

        def one_file(df: DataFrame, path: str, veto: Callable[[], None]) -> None:
            df.coalesce(1).write.option("compression", config.compression).parquet(path)
            veto()

        report = run_bounded(spark, source, output, config, transform, cancel, one_file)
        parts = [os.path.join(output, f) for f in os.listdir(output) if f.endswith(".parquet")]
        if not parts:
            raise FileNotFoundError(f"no output was written for {input_key}")
        cancel.check()
        return report, publish(store, parts[0], output_key, meta, report.rows, report.digest)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def naive_csv_to_parquet(spark: SparkSession, source: str, output: str) -> None:
    """The plain baseline: read and write, without staging, digest or manifest."""
    ingest_csv(spark, source).write.mode("overwrite").parquet(output)

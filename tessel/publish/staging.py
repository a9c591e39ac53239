"""Staged local outputs: written aside, made durable, then put in place by one rename."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from .errors import PipelineIoError, StagingError, StagingPhase
from .safety import create_new


class StagedFile:
    """A file that takes its name only when ``publish`` has made it durable; until then an old output stays."""

    def __init__(self, path: str):
        self.path = os.path.abspath(path)
        self.temporary = os.path.join(os.path.dirname(self.path), f".{os.path.basename(self.path)}.{uuid.uuid4().hex}.staging")
        try:
            self.file = create_new(self.temporary)
        except OSError as e:
            raise StagingError(StagingPhase.CREATE, self.path, e) from e

    def _step(self, phase: StagingPhase, action) -> None:
        try:
            action()
        except OSError as e:
            if phase is not StagingPhase.PARENT_SYNC:
                self.discard()
            raise StagingError(phase, self.path, e) from e

    def write(self, data: bytes) -> None:
        self._step(StagingPhase.WRITE, lambda: self.file.write(data))

    def publish(self) -> None:
        self._step(StagingPhase.CLOSE, self.file.flush)
        self._step(StagingPhase.FILE_SYNC, lambda: os.fsync(self.file.fileno()))
        self._step(StagingPhase.CLOSE, self.file.close)
        self._step(StagingPhase.RENAME, lambda: os.replace(self.temporary, self.path))
        self._step(StagingPhase.PARENT_SYNC, self._sync_parent)

    def _sync_parent(self) -> None:
        fd = os.open(os.path.dirname(self.path), os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def discard(self) -> None:
        try:
            self.file.close()
        finally:
            if os.path.exists(self.temporary):
                os.unlink(self.temporary)

    def __enter__(self) -> StagedFile:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.discard()


def publish_dataframe(df: DataFrame, path: str, compression: str = "zstd", before_rename=None) -> None:
    """Writes a Parquet folder beside ``path`` and renames it there.

    The old folder is moved aside first and back if the rename fails; a failed write leaves it untouched.  On stores without
    atomic rename readers should go by a completion record instead.  ``before_rename`` may still veto.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    run = uuid.uuid4().hex
    staged, old = Path(f"{target.toString()}.staging-{run}"), Path(f"{target.toString()}.old-{run}")
    try:
        df.write.option("compression", compression).parquet(staged.toString())
        if before_rename:
            before_rename()
    except BaseException:
        fs.delete(staged, True)
        raise
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        fs.delete(staged, True)
        raise PipelineIoError(f"{path}: the old output could not be moved aside")
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        fs.delete(staged, True)
        raise PipelineIoError(f"{path}: the new output could not be put in place")
    if had:
        fs.delete(old, True)

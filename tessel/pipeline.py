"""Typed pipelines: a source, transforms and a sink whose declared schemas must fit, and whose data is held to them.

Connections are checked when a stage is added, all schemas are mapped at ``build`` before the source is opened, and data is
checked while it flows: a violated declaration fails the job before anything reaches the sink's output.  A transform
applies to the whole table once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .contracts import ContractViolation, MappingError, Policy, Validator, enforce, struct_type


class PipelineError(RuntimeError):
    """``stage`` is SourceFactory, Source, Transform(n) or Sink; ``kind`` is Mapping, Validation or Callback.

    ``batch_index`` is None before any data is read, and for pipelines over whole tables.  The cause is kept.
    """

    def __init__(self, stage: str, kind: str, cause: BaseException, batch_index: int | None = None):
        self.stage, self.kind, self.batch_index = stage, kind, batch_index
        super().__init__(f"{stage} at batch {batch_index}: {kind}: {str(cause).splitlines()[0] if str(cause) else cause!r}")
        self.__cause__ = cause


@dataclass(frozen=True)
class RunReport:
    batches_processed: int
    rows_processed: int


@dataclass(frozen=True)
class _Stage:
    contract: type
    run: Callable


def _map(stage: str, contract) -> Validator:
    try:
        return Validator(struct_type(contract))
    except MappingError as e:
        raise PipelineError(stage, "Mapping", e) from e


_MARK = re.compile(r"contract violation at <([^>]*)> path <([^>]*)>")


def guarded(df: DataFrame, validator: Validator, stage: str) -> DataFrame:
    """``df``, which fails where a required value is null.  The check is a filter, so it is never pruned away."""
    ok = F.lit(True)
    for path, broken in validator.conditions():
        ok = F.when(broken, F.raise_error(F.lit(f"contract violation at <{stage}> path <{path}>")).cast("boolean")).otherwise(ok)
    return df.where(ok) if validator.conditions() else df


@dataclass(frozen=True)
class Pipeline:
    """``Pipeline(spark).source(C, factory).transform(In, Out, fn)...sink(In, fn).build().run()``; each call gives a new pipeline."""

    spark: SparkSession
    opened: _Stage | None = None
    steps: tuple[_Stage, ...] = ()

    @property
    def _last(self):
        return (self.steps[-1] if self.steps else self.opened).contract

    def source(self, contract: type, factory: Callable[[], DataFrame]) -> Pipeline:
        if self.opened:
            raise TypeError("a pipeline has one source")
        return replace(self, opened=_Stage(contract, factory))

    def transform(self, takes: type, gives: type, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        if not self.opened:
            raise TypeError("a transform needs a source before it")
        enforce(self._last, takes, Policy.EXACT_ORDERED, "transform input")
        return replace(self, steps=(*self.steps, _Stage(gives, fn)))

    def df_transform(self, gives: type, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        if not self.opened:
            raise TypeError("a transform needs a source before it")
        return self.transform(self._last, gives, fn)

    def sql_transform(self, gives: type, sql: str) -> Pipeline:
        """SQL over the whole input, which is the view ``batch``."""

        def run(df: DataFrame) -> DataFrame:
            df.createOrReplaceTempView("batch")
            return self.spark.sql(sql)

        return self.df_transform(gives, run)

    def sink(self, takes: type, fn: Callable[[DataFrame], object]) -> SinkStage:
        if not self.opened:
            raise TypeError("a sink needs a source before it")
        enforce(self._last, takes, Policy.EXACT_ORDERED, "sink input")
        return SinkStage(self, _Stage(takes, fn))


@dataclass(frozen=True)
class SinkStage:
    pipeline: Pipeline
    end: _Stage

    def build(self) -> PreparedPipeline:
        """Maps every declaration; nothing is opened yet."""
        source = _map("Source", self.pipeline.opened.contract)
        steps = [_map(f"Transform({k})", s.contract) for k, s in enumerate(self.pipeline.steps)]
        _map("Sink", self.end.contract)
        return PreparedPipeline(self.pipeline, self.end, source, steps)


class PreparedPipeline:
    """Runs once over the whole table; nothing is read before the sink acts, and rows are counted on the way."""

    def __init__(self, pipeline: Pipeline, end: _Stage, source: Validator, steps: list[Validator]):
        self._pipeline, self._end, self._source, self._steps = pipeline, end, source, steps

    def _checked(self, stage: str, validator: Validator, make: Callable[[], DataFrame], factory: str | None = None) -> DataFrame:
        try:
            df = make()
        except Exception as e:
            raise PipelineError(factory or stage, "Callback", e) from e
        try:
            validator.check_schema(df)
        except ContractViolation as e:
            raise PipelineError(stage, "Validation", e) from e
        return guarded(df, validator, stage)

    def run(self) -> RunReport:
        df = self._checked("Source", self._source, self._pipeline.opened.run, "SourceFactory")
        for k, (step, validator) in enumerate(zip(self._pipeline.steps, self._steps)):
            df = self._checked(f"Transform({k})", validator, lambda step=step, df=df: step.run(df))
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        try:
            self._end.run(df)
        except Exception as e:
            found = _MARK.search(str(e))
            if found:
                raise PipelineError(found[1], "Validation", ContractViolation("NullValue", found[2], "a value", "null")) from e
            raise PipelineError("Sink", "Callback", e) from e
        return RunReport(1, seen.get["rows"])


def write_parquet_sink(path: str, compression: str = "zstd") -> Callable[[DataFrame], None]:
    """A sink that stages the whole output beside ``path`` and puts it there only when it is complete."""

    def sink(df: DataFrame) -> None:
        from .publish.staging import publish_dataframe

        publish_dataframe(df, path, compression=compression)

    return sink


class BatchPipeline:
    """The same contract, batch by batch, over an iterator of Arrow batches; for bounded local sources.

    The source is opened once.  A batch is checked after the source and after every transform and handed to the sink before
    the next is read; what the sink did before a failure is not undone.
    """

    def __init__(self, contract: type, factory: Callable[[], Iterable[pa.RecordBatch]], steps: list[tuple[type, Callable]], takes: type, sink: Callable):
        enforce(steps[-1][0] if steps else contract, takes, Policy.EXACT_ORDERED, "sink input")
        self._factory, self._steps, self._sink = factory, steps, sink
        self._source = _map("Source", contract)
        self._validators = [_map(f"Transform({k})", c) for k, (c, _) in enumerate(steps)]

    @staticmethod
    def _validate(stage: str, index: int, validator: Validator, batch: pa.RecordBatch) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(validator.schema)
        try:
            if batch.num_columns != len(want):
                raise ContractViolation("ColumnCount", "", len(want), batch.num_columns)
            for f, have, column in zip(want, batch.schema, batch.columns):
                if f.name != have.name:
                    raise ContractViolation("Name", f.name, f.name, have.name)
                if f.type != have.type:
                    raise ContractViolation("Type", f.name, f.type, have.type)
                if not f.nullable and column.null_count:
                    raise ContractViolation("NullValue", f.name, "a value", "null")
        except ContractViolation as e:
            raise PipelineError(stage, "Validation", e, index) from e

    def run(self) -> RunReport:
        try:
            batches = iter(self._factory())
        except Exception as e:
            raise PipelineError("SourceFactory", "Callback", e) from e
        n = rows = 0
        while True:
            try:
                batch = next(batches)
            except StopIteration:
                return RunReport(n, rows)
            except Exception as e:
                raise PipelineError("Source", "Callback", e, n) from e
            self._validate("Source", n, self._source, batch)
            for k, ((_, fn), validator) in enumerate(zip(self._steps, self._validators)):
                try:
                    batch = fn(batch)
                except Exception as e:
                    raise PipelineError(f"Transform({k})", "Callback", e, n) from e
                self._validate(f"Transform({k})", n, validator, batch)
            try:
                self._sink(batch)
            except Exception as e:
                raise PipelineError("Sink", "Callback", e, n) from e
            n, rows = n + 1, rows + batch.num_rows

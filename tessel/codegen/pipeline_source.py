"""Runnable pipelines from a source schema, an optional target schema, an optional transform and a Parquet sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..connectors import register
from ..pipeline import Pipeline, RunReport, write_parquet_sink
from .declared import SchemaError, parse_spec, resolve_schema, source_location
from .grammar import apply_ops, parse_op
from .source import HEADER, contract_class, struct_source


@dataclass(frozen=True)
class PipelineSpec:
    """What a pipeline does.  The transform sees the whole source once, under the name ``batch`` for SQL."""

    source_schema: str
    name: str
    sink_parquet: str
    source_data: str | None = None
    source_format: str | None = None
    target_schema: str | None = None
    transform_sql: str | None = None
    transform_df: tuple[str, ...] = field(default=())

    def resolved(self) -> tuple[T.StructType, T.StructType | None, str, str]:
        """Source schema, target schema, location and format; every text is checked."""
        if self.transform_sql and self.transform_df:
            raise SchemaError("ConflictingTransform", "either SQL or DataFrame operations")
        for op in self.transform_df:
            parse_op(op)
        spec = parse_spec(self.source_schema)
        target = resolve_schema(parse_spec(self.target_schema)) if self.target_schema else None
        return resolve_schema(spec), target, *source_location(spec, self.source_data, self.source_format)

    def run(self, spark: SparkSession) -> RunReport:
        """Builds the pipeline and runs it without generating text."""
        source, target, location, kind = self.resolved()
        In = contract_class(source, self.name)
        Out = contract_class(target, f"{self.name}Target") if target else In
        p = Pipeline(spark).source(In, lambda: register(spark, In, "batch_source", location, kind))
        if self.transform_sql:
            p = p.sql_transform(Out, self.transform_sql)
        elif self.transform_df:
            ops = [parse_op(t) for t in self.transform_df]
            p = p.df_transform(Out, lambda df: apply_ops(df, ops))
        return p.sink(Out, write_parquet_sink(self.sink_parquet)).build().run()


def pipeline_source(spec: PipelineSpec) -> str:
    """The text of a PySpark program that does what ``spec.run`` does."""
    source, target, location, kind = spec.resolved()
    out = f"{spec.name}Target" if target else spec.name
    if spec.transform_sql:
        step = f"    p = p.sql_transform({out}, {spec.transform_sql!r})\n"
    elif spec.transform_df:
        ops = "".join(f"\n        parse_op({t!r})," for t in spec.transform_df)
        step = f"    ops = [{ops}\n    ]\n    p = p.df_transform({out}, lambda df: apply_ops(df, ops))\n"
    else:
        step = ""
    classes = struct_source(source, spec.name) + ("\n\n" + struct_source(target, out) if target else "")
    return f'''"""Pipeline from {location!r} to {spec.sink_parquet!r}."""

{HEADER.rstrip()}
from tessel.codegen import apply_ops, parse_op
from tessel.connectors import register
from tessel.pipeline import Pipeline, write_parquet_sink
from tessel.session import session


{classes}

def main():
    spark = session({spec.name!r})
    p = Pipeline(spark).source({spec.name}, lambda: register(spark, {spec.name}, "batch_source", {location!r}, {kind!r}))
{step}    report = p.sink({out}, write_parquet_sink({spec.sink_parquet!r})).build().run()
    print(report)


if __name__ == "__main__":
    main()
'''

"""Pipelines from declared schemas: dbt, Erwin, Parquet and Delta declarations, an operation grammar and a generator."""

from .declared import SchemaError, SchemaSpec, dbt_schema, delta_schema, erwin_schema, parquet_schema, parse_spec, resolve_schema
from .grammar import Aggregate, Filter, Limit, Select, Sort, apply_ops, parse_literal, parse_op
from .source import contract_class, struct_source
from .pipeline_source import PipelineSpec, pipeline_source

__all__ = [
    "Aggregate", "Filter", "Limit", "PipelineSpec", "SchemaError", "SchemaSpec", "Select", "Sort", "apply_ops", "contract_class", "dbt_schema", "delta_schema",
    "erwin_schema", "parquet_schema", "parse_literal", "parse_op", "parse_spec", "pipeline_source", "resolve_schema", "struct_source",
]

"""Declared schemas: shapes, compatibility policies, mapping to Spark types and checks on data."""

from .derive import F32, F64, I8, I16, I32, I64, U8, U16, U32, U64, Char, contract, default, shape_of
from .policy import ContractMismatch, Diff, DiffKind, Policy, compare, conforms, enforce
from .shape import Field, Map, Optional, Primitive, Sequence, Shape, Struct
from .spark_types import MappingError, shape_from_spark, spark_field, struct_type
from .validate import ContractViolation, Validator, ingest_violation, validate_ingest

__all__ = [
    "F32", "F64", "I8", "I16", "I32", "I64", "U8", "U16", "U32", "U64", "Char", "ContractMismatch", "ContractViolation", "Diff", "DiffKind", "Field",
    "Map", "MappingError", "Optional", "Policy", "Primitive", "Sequence", "Shape", "Struct", "Validator", "compare", "conforms", "contract", "default",
    "enforce", "ingest_violation", "shape_from_spark", "shape_of", "spark_field", "struct_type", "validate_ingest",
]

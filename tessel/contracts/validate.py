"""Checks of real data against declarations.

Spark relaxes nullability on read, so a declared required value is checked on the data: the whole contract is turned
into one aggregate of violation counts, evaluated in a single pass on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_types import struct_type


class ContractViolation(ValueError):
    """``kind`` is ColumnCount, Name, Type, Nullability or NullValue; ``path`` names the field."""

    def __init__(self, kind: str, path: str, expected: object = "", found: object = ""):
        self.kind, self.path, self.expected, self.found = kind, path, expected, found
        super().__init__(f"{kind} at `{path}`: expected {expected}, found {found}")


def _plain(kind: T.DataType) -> T.DataType:
    """A type without nullability and metadata."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_plain(kind.keyType), _plain(kind.valueType), True)
    return kind


def _nulls(value: Column, kind: T.DataType, nullable: bool, path: str) -> list[tuple[str, Column]]:
    """Conditions under which a required value below ``value`` is null; a null parent hides what is below it."""
    out = [] if nullable else [(path, value.isNull())]
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            own = f"{path}.{f.name}" if path else f.name
            out += [(p, value.isNotNull() & c) for p, c in _nulls(value.getField(f.name), f.dataType, f.nullable, own)]
    elif isinstance(kind, T.ArrayType):
        for p, _ in _nulls(F.lit(None), kind.elementType, kind.containsNull, f"{path}.[]"):
            out.append((p, F.coalesce(F.exists(value, _picker(kind.elementType, kind.containsNull, f"{path}.[]", p)), F.lit(False))))
    elif isinstance(kind, T.MapType):
        for p, _ in _nulls(F.lit(None), kind.valueType, kind.valueContainsNull, f"{path}.<value>"):
            values = F.map_values(value)
            out.append((p, F.coalesce(F.exists(values, _picker(kind.valueType, kind.valueContainsNull, f"{path}.<value>", p)), F.lit(False))))
    return out


def _picker(kind: T.DataType, nullable: bool, path: str, wanted: str):
    return lambda x: F.coalesce(next(c for p, c in _nulls(x, kind, nullable, path) if p == wanted), F.lit(False))


@dataclass(frozen=True)
class Validator:
    """Checks data frames against one declared schema: names, order, types and required values at every depth."""

    schema: T.StructType

    @staticmethod
    def of(kind) -> Validator:
        return Validator(kind if isinstance(kind, T.StructType) else struct_type(kind))

    def check_schema(self, df: DataFrame, strict_nullability: bool = False) -> None:
        """Raises at the first of: number of columns, a name, a type, and, if asked for, nullability."""
        found = df.schema
        if len(found) != len(self.schema):
            raise ContractViolation("ColumnCount", "", len(self.schema), len(found))
        for want, have in zip(self.schema, found):
            if want.name != have.name:
                raise ContractViolation("Name", want.name, want.name, have.name)
            if _plain(want.dataType) != _plain(have.dataType):
                raise ContractViolation("Type", want.name, want.dataType.simpleString(), have.dataType.simpleString())
            if strict_nullability and want.nullable != have.nullable:
                raise ContractViolation("Nullability", want.name, want.nullable, have.nullable)

    def conditions(self) -> list[tuple[str, Column]]:
        """Path and condition of every required value."""
        out = []
        for f in self.schema.fields:
            out += [(p, F.coalesce(c, F.lit(False))) for p, c in _nulls(F.col(f"`{f.name}`"), f.dataType, f.nullable, f.name)]
        return out

    def violations(self, df: DataFrame) -> DataFrame:
        """``path`` and ``n_rows`` of every required value, also of those without violation; one pass over the data."""
        checks = self.conditions()
        if not checks:
            return df.sparkSession.createDataFrame([], "path string, n_rows bigint")
        counts = df.agg(*(F.coalesce(F.count_if(c), F.lit(0)).alias(f"_{k}") for k, (_, c) in enumerate(checks)))
        return counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"_{k}").alias("n_rows")) for k, (p, _) in enumerate(checks)))).alias("x")).select("x.*")

    def check(self, df: DataFrame, strict_nullability: bool = False) -> None:
        """Raises ``ContractViolation`` for the schema, or for the first required value that is null in some row."""
        self.check_schema(df, strict_nullability)
        for row in self.violations(df).collect():
            if row.n_rows:
                raise ContractViolation("NullValue", row.path, "a value", f"null in {row.n_rows} rows")


#: The ingest table: id and name are required, note is not.
INGEST = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False), T.StructField("note", T.StringType(), True)])


def validate_ingest(df: DataFrame) -> None:
    """Raises the first violation of the ingest contract, if any."""
    Validator(INGEST).check(df)


def ingest_violation(df: DataFrame) -> ContractViolation | None:
    try:
        validate_ingest(df)
    except ContractViolation as e:
        return e
    return None

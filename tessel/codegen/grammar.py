"""The grammar of DataFrame operations: ``select: filter: aggregate: sort: limit:``."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .declared import SchemaError

COMPARATORS = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "lt": operator.lt, "ge": operator.ge, "le": operator.le}
AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
_INTEGER = re.compile(r"[+-]?[0-9]+", re.ASCII)
_FLOAT = re.compile(r"[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)", re.ASCII | re.IGNORECASE)


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)


@dataclass(frozen=True)
class Filter:
    column: str
    comparator: str
    value: object

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(COMPARATORS[self.comparator](F.col(self.column), F.lit(self.value)))


@dataclass(frozen=True)
class Aggregate:
    """``terms`` are (function, column, alias); no group is the whole table."""

    group_by: tuple[str, ...]
    terms: tuple[tuple[str, str, str], ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.group_by).agg(*(AGGREGATES[f](c).alias(a) for f, c, a in self.terms))


@dataclass(frozen=True)
class Sort:
    """``keys`` are (column, ascending); nulls are last either way."""

    keys: tuple[tuple[str, bool], ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*((F.asc_nulls_last if up else F.desc_nulls_last)(c) for c, up in self.keys))


@dataclass(frozen=True)
class Limit:
    n: int

    def apply(self, df: DataFrame) -> DataFrame:
        from ..operators.guardrail import row_cap

        return row_cap(df, self.n)


def parse_literal(text: str) -> object:
    """A 64-bit whole number, else a float (inf and nan, too), else true or false, else the text."""
    if _INTEGER.fullmatch(text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if _FLOAT.fullmatch(text):
        return float(text)
    return {"true": True, "false": False}.get(text, text)


def _aggregate(rest: str) -> Aggregate | None:
    group, semicolon, terms = rest.partition(";")
    if not semicolon or not group.startswith("group="):
        return None
    columns = group.removeprefix("group=")
    found = [re.fullmatch(r"(\w+)\(([^)]*)\)=(.*)", t, re.DOTALL) for t in terms.split(",")]
    if not all(m and m[1] in AGGREGATES for m in found):
        return None
    return Aggregate(tuple(columns.split(",")) if columns else (), tuple((m[1], m[2], m[3]) for m in found))


def _sort(rest: str) -> Sort | None:
    keys = [t.partition(",") for t in rest.split(";")]
    if not all(d in ("asc", "desc") for _, _, d in keys):
        return None
    return Sort(tuple((c, d == "asc") for c, _, d in keys))


def parse_op(text: str):
    """One operation; a filter's value may hold commas.  Anything else raises InvalidTransform."""
    kind, colon, rest = text.partition(":")
    op = None
    if colon and kind == "select":
        op = Select(tuple(rest.split(",")))
    elif colon and kind == "filter":
        parts = rest.split(",", 2)
        if len(parts) == 3 and parts[1] in COMPARATORS:
            op = Filter(parts[0], parts[1], parse_literal(parts[2]))
    elif colon and kind == "aggregate":
        op = _aggregate(rest)
    elif colon and kind == "sort":
        op = _sort(rest)
    elif colon and kind == "limit" and re.fullmatch(r"\+?[0-9]+", rest, re.ASCII):
        op = Limit(int(rest))
    if op is None:
        raise SchemaError("InvalidTransform", text)
    return op


def apply_ops(df: DataFrame, ops: list) -> DataFrame:
    for op in ops:
        df = op.apply(df)
    return df

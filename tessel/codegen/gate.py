"""The schema gate: schemas from different declarations must equal a steward's model, in order and exactly."""

from __future__ import annotations

from pyspark.sql import types as T

from ..contracts import Policy, Shape, enforce, shape_from_spark
from ..contracts.derive import shape_of
from .declared import parse_spec, resolve_schema


def _shape(source) -> Shape:
    if isinstance(source, str):
        source = resolve_schema(parse_spec(source))
    return shape_from_spark(source) if isinstance(source, T.DataType) else shape_of(source)


def check_gate(model, sources: list, policy: Policy = Policy.EXACT_ORDERED) -> None:
    """Raises ``ContractMismatch`` at the first source that differs; each may be a schema spec, a Spark schema or a contract."""
    wanted = _shape(model)
    for source in sources:
        enforce(_shape(source), wanted, policy, what=source if isinstance(source, str) else getattr(source, "__name__", "schema"))

"""Contract classes from schemas, as source text or as classes."""

from __future__ import annotations

import keyword

from pyspark.sql import types as T

from ..contracts import derive
from .declared import SchemaError

_NAMES = {T.BooleanType: "bool", T.ByteType: "I8", T.ShortType: "I16", T.IntegerType: "I32", T.LongType: "I64", T.FloatType: "F32", T.DoubleType: "F64", T.StringType: "str"}


def _class_name(parent: str, field: str) -> str:
    return parent + "".join(w[:1].upper() + w[1:] for w in field.split("_"))


def _annotation(kind: T.DataType, parent: str, field: str, logical: str | None, out: list[str], done: set[str]) -> str:
    if isinstance(kind, T.StructType):
        name = _class_name(parent, field)
        _emit(kind, name, out, done)
        return name
    if isinstance(kind, T.ArrayType):
        item = _annotation(kind.elementType, parent, field, None, out, done)
        return f"list[{f'Optional[{item}]' if kind.containsNull else item}]"
    if logical:
        return logical.upper()
    if type(kind) not in _NAMES:
        raise SchemaError("UnsupportedType", f"{field}: {kind.simpleString()}")
    return _NAMES[type(kind)]


def _emit(schema: T.StructType, name: str, out: list[str], done: set[str]) -> None:
    """Appends the class after those of its nested structs."""
    lines = []
    for f in schema.fields:
        if not f.name.isidentifier() or keyword.iskeyword(f.name):
            raise SchemaError("InvalidName", f.name)
        kind = _annotation(f.dataType, name, f.name, (f.metadata or {}).get("logical"), out, done)
        lines.append(f"    {f.name}: {f'Optional[{kind}]' if f.nullable else kind}")
    if not name.isidentifier() or keyword.iskeyword(name) or name in done:
        raise SchemaError("InvalidName", name)
    done.add(name)
    out.append("\n".join([f"@contract\nclass {name}:", *(lines or ["    pass"])]))


def struct_source(schema: T.StructType, name: str) -> str:
    """Source of a contract class and, before it, of the classes of its nested structs, innermost first."""
    out: list[str] = []
    _emit(schema, name, out, set())
    return "\n\n\n".join(out) + "\n"


HEADER = "from typing import Optional\n\nfrom tessel.contracts import F32, F64, I8, I16, I32, I64, U8, U16, U32, U64, contract\n"


def contract_class(schema: T.StructType, name: str) -> type:
    """The class itself."""
    import typing

    scope = {**vars(derive), "Optional": typing.Optional}
    exec(struct_source(schema, name), scope)  # noqa: S102 - text made here from checked names
    return scope[name]

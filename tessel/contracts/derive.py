"""Contracts declared as annotated classes.

``@contract`` turns a class with annotations into a contract: its shape, its Spark schema, and ``Order.c.id`` for
each column.  A renamed field breaks ``Order.c.old_name`` with an AttributeError.
"""

from __future__ import annotations

import sys
import types
import typing
from typing import Annotated, Any

from pyspark.sql import functions as F

from .shape import Field, Map, Optional, Primitive, Sequence, Shape, Struct

I8, I16, I32, I64 = (Annotated[int, Primitive(f"i{n}")] for n in (8, 16, 32, 64))
U8, U16, U32, U64 = (Annotated[int, Primitive(f"u{n}")] for n in (8, 16, 32, 64))
F32, F64 = (Annotated[float, Primitive(f"f{n}")] for n in (32, 64))
Char = Annotated[str, Primitive("char")]

_PLAIN = {bool: "bool", int: "i64", float: "f64", str: "String"}
#: Map keys must be whole: truth values, texts and integers.
_KEYS = {"bool", "String", *(f"{s}{n}" for s in "iu" for n in (8, 16, 32, 64, 128)), "isize", "usize"}


class _Default:
    """Marks a field that may be absent under the backward policy."""


def default() -> Any:
    return _Default()


class _Columns:
    def __init__(self, names: list[str]):
        self._names = set(names)

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._names:
            raise AttributeError(f"the contract has no field {name!r}")
        return F.col(f"`{name}`")


def shape_of(kind) -> Shape:
    """The shape of a contract class, an annotation, or a shape itself."""
    if isinstance(kind, Shape):
        return kind
    if isinstance(kind, type) and isinstance(kind.__dict__.get("__shape__"), Shape):
        return kind.__shape__
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is Annotated:
        found = [a for a in args[1:] if isinstance(a, Shape)]
        return found[0] if found else shape_of(args[0])
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1 and len(rest) < len(args):
            return Optional(shape_of(rest[0]))
    if origin is list:
        return Sequence(shape_of(args[0]))
    if origin is dict:
        key = shape_of(args[0])
        if not isinstance(key, Primitive) or key.name not in _KEYS:
            raise TypeError(f"map keys must be truth values, texts or integers, not {key.label}")
        return Map(key, shape_of(args[1]))
    if kind in _PLAIN:
        return Primitive(_PLAIN[kind])
    raise TypeError(f"{kind!r} has no shape")


def contract(cls: type) -> type:
    """Makes a contract of a class with annotated fields.  Generic classes and classes without fields are refused."""
    if getattr(cls, "__parameters__", ()) or getattr(cls, "__type_params__", ()):
        raise TypeError(f"{cls.__name__}: a contract cannot be generic")
    own = vars(cls).get("__annotations__") or getattr(cls, "__annotations__", {})
    if not own:
        raise TypeError(f"{cls.__name__}: a contract needs named fields")
    scope = {**vars(typing), **vars(sys.modules[cls.__module__]), **_caller_names()} if any(isinstance(a, str) for a in own.values()) else None
    hints = {}
    for n, a in own.items():
        while isinstance(a, str):
            a = eval(a, scope)  # noqa: S307 - the program's own annotations
        hints[n] = a
    cls.__shape__ = Struct(tuple(Field(n, shape_of(a), isinstance(vars(cls).get(n), _Default)) for n, a in hints.items()))
    cls.c = _Columns(list(hints))
    return cls


def _caller_names() -> dict:
    """Names at the place of the class statement, for annotations kept as text."""
    frame = sys._getframe(2)
    return {**frame.f_globals, **frame.f_locals}

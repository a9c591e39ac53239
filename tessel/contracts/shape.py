"""The shape of a declared type, independent of any engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Shape:
    @property
    def label(self) -> str:
        return type(self).__name__


@dataclass(frozen=True)
class Primitive(Shape):
    name: str

    @property
    def label(self) -> str:
        return self.name


@dataclass(frozen=True)
class Optional(Shape):
    inner: Shape


@dataclass(frozen=True)
class Sequence(Shape):
    item: Shape


@dataclass(frozen=True)
class Map(Shape):
    key: Shape
    value: Shape


@dataclass(frozen=True)
class Field:
    name: str
    shape: Shape
    has_default: bool = False


@dataclass(frozen=True)
class Struct(Shape):
    fields: tuple[Field, ...] = ()

"""Mapping between shapes and Spark types.

Spark has no unsigned integers: they are widened, and the declared width stays in the field's metadata under
``logical``, so u32 and i64 remain different declarations.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .derive import shape_of
from .shape import Field, Map, Optional, Primitive, Sequence, Shape, Struct

MOST_LEVELS = 128

_TYPES = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "String": T.StringType(), "str": T.StringType(),
}
_UNSIGNED = ("u8", "u16", "u32", "u64")
_NAMES = {T.BooleanType: "bool", T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.StringType: "String"}


class MappingError(TypeError):
    """``kind`` is RootNotStruct, UnsupportedPrimitive, NestedOptional, InvalidMapKey, DuplicateField or DepthLimit."""

    def __init__(self, kind: str, path: str = "", primitive: str = ""):
        self.kind, self.path, self.primitive = kind, path, primitive
        super().__init__(" ".join(x for x in (kind, path and f"at `{path}`", primitive and f"({primitive})") if x))


def _data_type(shape: Shape, path: str, level: int) -> T.DataType:
    if level > MOST_LEVELS:
        raise MappingError("DepthLimit", path)
    if isinstance(shape, Primitive):
        if shape.name not in _TYPES:
            raise MappingError("UnsupportedPrimitive", path, shape.name)
        return _TYPES[shape.name]
    if isinstance(shape, Optional):
        if isinstance(shape.inner, Optional):
            raise MappingError("NestedOptional", path)
        return _data_type(shape.inner, path, level + 1)
    if isinstance(shape, Sequence):
        return T.ArrayType(_data_type(shape.item, f"{path}.[]", level + 1), isinstance(shape.item, Optional))
    if isinstance(shape, Map):
        key = shape.key
        if not isinstance(key, Primitive) or key.name in ("f32", "f64"):
            raise MappingError("InvalidMapKey", f"{path}.<key>")
        return T.MapType(_data_type(key, f"{path}.<key>", level + 1), _data_type(shape.value, f"{path}.<value>", level + 1), isinstance(shape.value, Optional))
    names: set[str] = set()
    out = []
    for f in shape.fields:
        own = f"{path}.{f.name}" if path else f.name
        if f.name in names:
            raise MappingError("DuplicateField", own)
        names.add(f.name)
        out.append(_field(f, own, level + 1))
    return T.StructType(out)


def _field(f: Field, path: str, level: int) -> T.StructField:
    core = f.shape.inner if isinstance(f.shape, Optional) else f.shape
    tag = {"logical": core.name} if isinstance(core, Primitive) and core.name in _UNSIGNED else {}
    return T.StructField(f.name, _data_type(f.shape, path, level), isinstance(f.shape, Optional), tag)


def spark_field(name: str, kind) -> T.StructField:
    """One field from a shape, a contract class or an annotation."""
    return _field(Field(name, shape_of(kind)), name, 0)


def struct_type(kind) -> T.StructType:
    """The Spark schema of a contract; its root must be a struct."""
    shape = shape_of(kind)
    if not isinstance(shape, Struct):
        raise MappingError("RootNotStruct")
    return _data_type(shape, "", 0)


def shape_from_spark(kind: T.DataType, logical: str | None = None) -> Shape:
    """The shape of a Spark type.  Types that contracts cannot declare get their own Spark name as label."""
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            inner = shape_from_spark(f.dataType, (f.metadata or {}).get("logical"))
            fields.append(Field(f.name, Optional(inner) if f.nullable else inner))
        return Struct(tuple(fields))
    if isinstance(kind, T.ArrayType):
        item = shape_from_spark(kind.elementType)
        return Sequence(Optional(item) if kind.containsNull else item)
    if isinstance(kind, T.MapType):
        value = shape_from_spark(kind.valueType)
        return Map(shape_from_spark(kind.keyType), Optional(value) if kind.valueContainsNull else value)
    return Primitive(logical or _NAMES.get(type(kind), kind.simpleString()))

"""Schemas from declarations: dbt YAML, Erwin XML, Parquet footers and Delta logs; no data is read."""

from __future__ import annotations

import glob
import json
import os
from dataclasses import dataclass
from urllib.parse import urlparse
from xml.etree import ElementTree

from pyspark.sql import types as T

from ..contracts.spark_types import spark_field
from ..contracts.shape import Primitive

#: Type names in declarations, by primitive.
TYPE_NAMES = {
    "bool": ("boolean", "bool"), "i8": ("int8", "tinyint"), "i16": ("int16", "smallint"), "i32": ("int32", "integer", "int"), "i64": ("int64", "bigint"),
    "u8": ("uint8",), "u16": ("uint16",), "u32": ("uint32",), "u64": ("uint64",), "f32": ("float32", "float", "real"),
    "f64": ("float64", "double", "double precision"), "String": ("string", "varchar", "text", "character varying", "char"),
}
#: Types that are read only if asked for: the declarations' own rules leave them out.
EXTENDED_NAMES = {"date": T.DateType(), "timestamp": T.TimestampNTZType()}

_PRIMITIVE = {n: p for p, names in TYPE_NAMES.items() for n in names}


class SchemaError(ValueError):
    """``kind`` names the failure: ModelNotFound, EntityNotFound, ParseDbtYaml, ParseErwinXml, UnsupportedDeclaredType,
    InvalidDeltaUri, OpenDeltaTable, OpenFile, InvalidSpec, MissingSourceData, UnknownFormat, UnsupportedType, InvalidName,
    ConflictingTransform or InvalidTransform."""

    def __init__(self, kind: str, detail: str = ""):
        self.kind, self.detail = kind, detail
        super().__init__(f"{kind}: {detail}" if detail else kind)


def _fields(inner: str) -> list[str]:
    """The parts of a field list at its top level of commas."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(inner):
        depth += (c == "<") - (c == ">" and depth > 0)
        if c == "," and not depth:
            parts.append(inner[start:k])
            start = k + 1
    return [*parts, inner[start:]]


def declared_field(name: str, text: str, nullable: bool, extended: bool = False) -> T.StructField | None:
    """A field from the text of its type, None if the text names no known type.

    Names are case-insensitive, a precision in brackets is ignored, nested fields are nullable.  ``extended`` also takes
    date, timestamp and decimal(p,s).
    """
    text = text.strip()
    lower = text.lower()
    for wrapper in ("array<", "struct<"):
        if lower.startswith(wrapper):
            if not text.endswith(">"):
                return None
            inner = text[len(wrapper) : -1]
            if wrapper == "array<":
                item = declared_field("item", inner, True, extended)
                return item and T.StructField(name, T.ArrayType(item.dataType, True), nullable)
            fields = []
            for part in _fields(inner):
                own, colon, kind = part.partition(":")
                field = declared_field(own.strip(), kind, True, extended) if colon else None
                if field is None:
                    return None
                fields.append(field)
            return T.StructField(name, T.StructType(fields), nullable)
    token = lower.split("(")[0].strip()
    if token in _PRIMITIVE:
        field = spark_field(name, Primitive(_PRIMITIVE[token]))
        return T.StructField(name, field.dataType, nullable, field.metadata)
    if extended and token in EXTENDED_NAMES:
        return T.StructField(name, EXTENDED_NAMES[token], nullable)
    if extended and token == "decimal" and "(" in lower:
        p, _, s = lower.partition("(")[2].rstrip(") ").partition(",")
        return T.StructField(name, T.DecimalType(int(p), int(s or 0)), nullable)
    return None


def _required(name: str, text: str | None, nullable: bool, extended: bool) -> T.StructField:
    field = declared_field(name, "<none>" if text is None else str(text), nullable, extended)
    if field is None:
        raise SchemaError("UnsupportedDeclaredType", f"{name}: {text if text is not None else '<none>'}")
    return field


def dbt_schema(text: str, model: str, extended: bool = False) -> T.StructType:
    """The schema of a model in a dbt ``schema.yml``; a column is nullable unless it has a ``not_null`` test."""
    import yaml

    try:
        document = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SchemaError("ParseDbtYaml", str(e)) from e
    models = (document or {}).get("models") or [] if isinstance(document or {}, dict) else None
    if not isinstance(models, list) or not all(isinstance(m, dict) and "name" in m for m in models):
        raise SchemaError("ParseDbtYaml", "models must be a list of named models")
    found = next((m for m in models if m["name"] == model), None)
    if found is None:
        raise SchemaError("ModelNotFound", model)
    out = []
    for c in found.get("columns") or []:
        tests = c.get("tests") or []
        required = any(t == "not_null" or isinstance(t, dict) and "not_null" in t for t in tests)
        out.append(_required(c["name"], c.get("data_type"), not required, extended))
    return T.StructType(out)


def erwin_schema(text: str, entity: str, extended: bool = False) -> T.StructType:
    """The schema of an Entity in the XML subset ``Entities/Entity/Attribute``; without ``nullable`` it is nullable."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise SchemaError("ParseErwinXml", str(e)) from e
    found = next((e for e in root.iter("Entity") if e.get("name") == entity), None)
    if found is None:
        raise SchemaError("EntityNotFound", entity)
    return T.StructType([_required(a.get("name", ""), a.get("type"), a.get("nullable", "true") == "true", extended) for a in found.findall("Attribute")])


def delta_schema(uri: str) -> T.StructType:
    """The current schema of a Delta table, from the last ``metaData`` action of its log."""
    from ..sources.delta import log_actions

    path = urlparse(uri)
    if not path.scheme:
        raise SchemaError("InvalidDeltaUri", uri)
    try:
        actions = log_actions(uri)
    except FileNotFoundError as e:
        raise SchemaError("OpenDeltaTable", str(e)) from e
    if not actions.schema:
        raise SchemaError("OpenDeltaTable", f"no metadata in {uri}")
    return T.StructType.fromJson(json.loads(actions.schema))


def parquet_schema(path: str) -> T.StructType:
    """The schema in the footer of a Parquet file, or of the first file of a folder, with its nullability."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    files = [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(glob.escape(path), "*.parquet")))
    if not files:
        raise SchemaError("OpenFile", path)
    return from_arrow_schema(pq.read_schema(files[0]))


@dataclass(frozen=True)
class SchemaSpec:
    """``kind`` is parquet, delta, dbt or erwin; ``name`` the model or entity."""

    kind: str
    path: str
    name: str = ""


def parse_spec(spec: str) -> SchemaSpec:
    """``parquet:<path>``, ``delta:<uri>``, ``dbt:<yaml>:<model>`` or ``erwin:<xml>:<entity>``; the last colon parts the name."""
    kind, colon, rest = spec.partition(":")
    if colon and kind in ("parquet", "delta"):
        return SchemaSpec(kind, rest)
    if colon and kind in ("dbt", "erwin"):
        path, colon, name = rest.rpartition(":")
        if colon:
            return SchemaSpec(kind, path, name)
    raise SchemaError("InvalidSpec", spec)


def resolve_schema(spec: SchemaSpec, extended: bool = False) -> T.StructType:
    if spec.kind == "parquet":
        return parquet_schema(spec.path)
    if spec.kind == "delta":
        return delta_schema(spec.path)
    try:
        with open(spec.path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise SchemaError("OpenFile", str(e)) from e
    return (dbt_schema if spec.kind == "dbt" else erwin_schema)(text, spec.name, extended)


def source_location(spec: SchemaSpec, data: str | None, file_format: str | None = None) -> tuple[str, str]:
    """Where the pipeline reads and in what format: given, part of the spec, or by the suffix .csv or .parquet."""
    if data is None:
        if spec.kind not in ("parquet", "delta"):
            raise SchemaError("MissingSourceData", f"{spec.kind}:...")
        return spec.path, file_format or spec.kind
    suffix = next((k for k in ("csv", "parquet") if data.endswith("." + k)), None)
    if file_format or suffix:
        return data, file_format or suffix
    if spec.kind == "delta":
        return data, "delta"
    raise SchemaError("UnknownFormat", data)

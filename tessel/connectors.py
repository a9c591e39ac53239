"""Tables under a declared schema: the contract is believed, and drift of the file is an error."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import struct_type
from .contracts.validate import ContractViolation, Validator
from .publish.completed import download_to_temp
from .publish.store import HadoopStore, ObjectStore
from .scale import shared_path
from .sources.delta import read_delta
from .sources.ipc import read_ipc
from .sources.memory import memory_table
from .sources.parquet import check_declared


def register_memory(spark: SparkSession, contract, name: str, data: pa.Table | list[pa.RecordBatch]) -> DataFrame:
    return memory_table(spark, data, name, struct_type(contract))


def register_parquet(spark: SparkSession, contract, name: str, path: str, every_file: bool = False) -> DataFrame:
    """Reads with the declared schema after comparing it with the footer (of every file, if asked for)."""
    schema = struct_type(contract)
    check_declared(spark, path, schema, every_file)
    df = spark.read.schema(schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df


def register_csv(spark: SparkSession, contract, name: str, path: str) -> DataFrame:
    """Headered CSV with the declared schema; a bad value, record or header fails.  Required texts that are empty stay empty."""
    schema = struct_type(contract)
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    reader = spark.read.schema(loose).option("header", True).option("multiLine", True).option("mode", "FAILFAST").option("escape", '"').option("enforceSchema", False)
    df = reader.csv(path)
    df = df.select(*(F.coalesce(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) and not f.nullable else F.col(f.name) for f in schema))
    df.createOrReplaceTempView(name)
    return df


def register_delta(spark: SparkSession, contract, name: str, uri: str) -> DataFrame:
    df = read_delta(spark, uri)
    Validator.of(contract).check_schema(df)
    df.createOrReplaceTempView(name)
    return df


def register_ipc(spark: SparkSession, contract, name: str, path: str) -> DataFrame:
    df = read_ipc(spark, path)
    Validator.of(contract).check_schema(df)
    df.createOrReplaceTempView(name)
    return df


def register_object(spark: SparkSession, name: str, uri: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Parquet at any URI the Hadoop file systems of the session know; ``settings`` are set for that file system first."""
    conf = spark._jsc.hadoopConfiguration()
    for k, v in (settings or {}).items():
        conf.set(k, v)
    df = spark.read.parquet(uri)
    df.createOrReplaceTempView(name)
    return df


def register_from_store(spark: SparkSession, name: str, store: ObjectStore, key: str) -> DataFrame:
    """Parquet under a key of a given store: read in place where Spark knows the store, else from a copy of one identity of the
    object in the session's shared folder."""
    if isinstance(store, HadoopStore):
        return register_object(spark, name, f"{store.root}/{key}")
    dest = os.path.join(shared_path(spark), "object.parquet")
    download_to_temp(store, key, dest)
    return register_object(spark, name, f"file://{dest}")


KINDS = {"parquet": register_parquet, "csv": register_csv, "delta": register_delta, "ipc": register_ipc}


def register(spark: SparkSession, contract, name: str, path: str, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ContractViolation("Type", kind, "/".join(KINDS), kind)
    return KINDS[kind](spark, contract, name, path)

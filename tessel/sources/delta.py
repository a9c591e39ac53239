"""Delta tables from their log, for sessions without the Delta connector.

Where the session has the connector it is used.  Without it, the JSON log gives the schema and the live files, which
are read as Parquet; an overwrite writes new files and then one log entry that removes the old ones.  Tables with
checkpoints but without their whole JSON log, deletion vectors or column mapping need the connector.
"""

from __future__ import annotations

import glob
import json
import os
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class LogState:
    version: int = -1
    schema: str = ""
    partition_columns: list[str] = field(default_factory=list)
    files: dict[str, dict] = field(default_factory=dict)


def _local(uri: str) -> str:
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise FileNotFoundError(f"{uri}: without the Delta connector only local tables can be read")
    return unquote(parsed.path) if parsed.scheme else uri


def log_actions(uri: str) -> LogState:
    """Schema and live files of the last version."""
    folder = _local(uri)
    logs = sorted(glob.glob(os.path.join(glob.escape(folder), "_delta_log", "*.json")))
    if not logs:
        raise FileNotFoundError(f"{uri} has no Delta log")
    if os.path.basename(logs[0]) != f"{0:020d}.json":
        raise FileNotFoundError(f"{uri}: the log does not begin at version 0")
    state = LogState()
    for path in logs:
        state.version = int(os.path.basename(path)[:20])
        with open(path, encoding="utf-8") as f:
            for line in filter(str.strip, f):
                action = json.loads(line)
                if meta := action.get("metaData"):
                    state.schema, state.partition_columns = meta["schemaString"], meta.get("partitionColumns", [])
                elif add := action.get("add"):
                    if add.get("deletionVector"):
                        raise ValueError("deletion vectors need the Delta connector")
                    state.files[unquote(add["path"])] = add
                elif remove := action.get("remove"):
                    state.files.pop(unquote(remove["path"]), None)
    return state


def _connector(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("io.delta.sql.DeltaSparkSessionExtension")
    except Exception:
        return False
    return True


def read_delta(spark: SparkSession, uri: str) -> DataFrame:
    if _connector(spark):
        return spark.read.format("delta").load(uri)
    state, folder = log_actions(uri), _local(uri)
    schema = T.StructType.fromJson(json.loads(state.schema))
    if not state.files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*(os.path.join(folder, p) for p in sorted(state.files)))


def overwrite_delta(df: DataFrame, uri: str) -> int:
    """Replaces the table's rows and schema; returns the new version.  The log entry is created exclusively, so of two
    writers at the same version one fails."""
    spark = df.sparkSession
    if _connector(spark):
        df.write.format("delta").mode("overwrite").option("overwriteSchema", True).save(uri)
        return -1
    folder, now = _local(uri), int(time.time() * 1000)
    try:
        old = log_actions(uri)
    except FileNotFoundError:
        old = LogState()
    part = f"part-{uuid.uuid4()}"
    df.write.parquet(os.path.join(folder, part))
    actions = [] if old.version >= 0 else [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}]
    actions.append({"metaData": {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": [], "configuration": {}, "createdTime": now}})
    actions += [{"remove": {"path": p, "deletionTimestamp": now, "dataChange": True}} for p in old.files]
    for path in sorted(glob.glob(os.path.join(glob.escape(folder), part, "*.parquet"))):
        actions.append({"add": {"path": os.path.relpath(path, folder), "partitionValues": {}, "size": os.path.getsize(path), "modificationTime": now, "dataChange": True}})
    log = os.path.join(folder, "_delta_log")
    os.makedirs(log, exist_ok=True)
    with open(os.path.join(log, f"{old.version + 1:020d}.json"), "x", encoding="utf-8") as f:
        f.writelines(json.dumps(a) + "\n" for a in actions)
    return old.version + 1

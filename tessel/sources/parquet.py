"""Parquet: strict reads, single and partitioned writes, footers and layouts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..contracts.validate import INGEST, ContractViolation, Validator

#: Layouts to compare: codec, its level, and the most rows of a row group.
LAYOUTS = {"snappy": ("snappy", None, None), "zstd": ("zstd", 3, None), "snappy_small_groups": ("snappy", None, 65_536)}


def read_ingest(spark: SparkSession, path: str) -> DataFrame:
    """The ingest table; a file of another schema raises ``ContractViolation``."""
    df = spark.read.parquet(path)
    Validator(INGEST).check_schema(df)
    return df


def write_single(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """One file, for small results; other results are better written by ``write_partitioned``."""
    df.coalesce(1).write.mode("overwrite").option("compression", compression).parquet(path)


def write_partitioned(df: DataFrame, path: str, parts: int | None = None, compression: str = "zstd", rows_per_file: int = 5_000_000) -> None:
    """One file for each of ``parts`` even partitions, or for each partition as it stands, cut at ``rows_per_file``."""
    out = df.repartition(parts) if parts else df
    out.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file).parquet(path)


_FOOTER = "path string, n_rows bigint, n_groups int, footer_bytes bigint, schema string, with_stats boolean"


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The footer of every file below ``path``, read on the executors: rows, groups, bytes, schema, statistics."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(p)
                with system.open_input_file(at) as f:
                    m = pq.ParquetFile(f).metadata
                    stats = all(m.row_group(g).column(c).is_stats_set for g in range(m.num_row_groups) for c in range(m.num_columns))
                    rows.append((p, m.num_rows, m.num_row_groups, m.serialized_size, str(m.schema.to_arrow_schema().remove_metadata()), stats))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _FOOTER.split(", ")])

    return files.mapInArrow(run, _FOOTER)


def layout_report(df: DataFrame, folder: str) -> DataFrame:
    """Writes ``df`` in every layout of ``LAYOUTS`` below ``folder`` and reports their footers."""
    out = None
    for name, (codec, level, rows) in LAYOUTS.items():
        w = df.write.mode("overwrite").option("compression", codec)
        if level is not None:
            w = w.option("parquet.compression.codec.zstd.level", level)
        if rows is not None:
            w = w.option("parquet.block.row.count.limit", rows)
        w.parquet(f"{folder}/{name}")
        from pyspark.sql import functions as F

        part = footers(df.sparkSession, f"{folder}/{name}").groupBy().agg(
            F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_groups").alias("n_groups"), F.sum("footer_bytes").alias("footer_bytes"), F.bool_and("with_stats").alias("with_stats")
        ).select(F.lit(name).alias("layout"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def check_declared(spark: SparkSession, path: str, schema, every_file: bool = False) -> None:
    """Raises if a declared column is missing from the files or has another type.

    Spark would fill a missing column with nulls.  One footer is looked at, or with ``every_file`` all of them.
    """
    found = spark.read.option("mergeSchema", every_file).parquet(path).schema
    have = {f.name: f.dataType for f in found}
    for f in schema.fields:
        if f.name not in have:
            raise ContractViolation("Name", f.name, f.name, "no such column")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ContractViolation("Type", f.name, f.dataType.simpleString(), have[f.name].simpleString())
    if every_file:
        names = [f.name for f in schema.fields]
        for row in footers(spark, path).select("path", "schema").distinct().toLocalIterator():
            inside = {line.split(":")[0] for line in row.schema.splitlines()}
            missing = [n for n in names if n not in inside]
            if missing:
                raise ContractViolation("Name", missing[0], missing[0], f"no such column in {row.path}")

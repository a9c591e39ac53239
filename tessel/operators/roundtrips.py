"""Queries through sources, sinks and pipelines: tables are written in a format, read back and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import I32, contract
from ..pipeline import Pipeline, write_parquet_sink
from ..scale import scratch
from ..sources import csv, delta, ipc
from ..sources.parquet import footers, write_partitioned
from ..streaming.bounded import run_bounded
from ..tables import table
from .catalogue import Query


def _plain(path: str) -> str:
    return path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith("file:") else path


def _headers_csv(spark: SparkSession, d: str) -> str:
    """The ingest rows with a name, as CSV."""
    path = scratch(spark)
    rows = table(spark, d, "headers").where(F.col("id").isNotNull() & F.col("name").isNotNull()).select("id", "name", "note")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").csv(path)
    return path


def csv_ingest(spark, d):
    return csv.ingest_csv(spark, _headers_csv(spark, d))


def bounded_ingest(spark, d):
    out = scratch(spark)
    report = run_bounded(spark, _headers_csv(spark, d), out)
    return spark.read.parquet(out).agg(F.count("*").alias("n_rows"), F.count("note").alias("n_notes")).withColumn("same_count", F.col("n_rows") == report.rows)


def delta_overwrite(spark, d):
    uri = scratch(spark)
    uri = uri if ":" in uri else f"file://{uri}"
    delta.overwrite_delta(table(spark, d, "shop_orders").limit(0), uri)
    delta.overwrite_delta(table(spark, d, "shop_orders"), uri)
    return delta.read_delta(spark, uri).groupBy("load_no").agg(F.count("*").alias("n_rows"))


def arrow_ipc(spark, d):
    path = _plain(scratch(spark))
    ipc.write_ipc(table(spark, d, "shop_orders").select("id", "amount", "note"), path)
    return ipc.read_ipc(spark, path, ["id", "amount"]).agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(20,2)").alias("total"))


def partitioned_dataset(spark, d):
    path = scratch(spark)
    write_partitioned(table(spark, d, "shipments"), path, 4)
    return footers(spark, path).agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_files"))


@contract
class _Order:
    id: int | None
    load_no: I32 | None


@contract
class _Total:
    load_no: I32 | None
    n_rows: int


def typed_pipeline(spark, d):
    out = scratch(spark)
    p = Pipeline(spark).source(_Order, lambda: table(spark, d, "shop_orders").select("id", "load_no"))
    p = p.transform(_Order, _Order, lambda df: df.where(F.col("id") > 100)).sql_transform(_Total, "SELECT load_no, count(*) AS n_rows FROM batch GROUP BY load_no")
    p.sink(_Total, write_parquet_sink(out)).build().run()
    return spark.read.parquet(out)


def generated_pipeline(spark, d):
    from ..codegen import PipelineSpec

    out = scratch(spark)
    ops = ("filter:o_totalprice,gt,100000.0", "aggregate:group=o_orderstatus;count(o_orderkey)=n_orders,max(o_totalprice)=most", "sort:o_orderstatus,asc")
    source = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark)
    source.write.parquet(path)
    target = scratch(spark)
    source.limit(0).groupBy("o_orderstatus").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_totalprice").alias("most")).coalesce(1).write.parquet(target)
    spec = PipelineSpec(f"parquet:{_plain(path)}", "Order", out, path, "parquet", f"parquet:{_plain(target)}", transform_df=ops)
    spec.run(spark)
    return spark.read.parquet(out)


_KEPT = "FROM headers WHERE id IS NOT NULL AND name IS NOT NULL"
ROUNDTRIPS: dict[str, Query] = {
    "csv_ingest": Query(csv_ingest, None, f"SELECT id, name, nullif(note, '') AS note {_KEPT}"),
    "bounded_ingest": Query(bounded_ingest, None, f"SELECT count(*) AS n_rows, count(nullif(note, '')) AS n_notes, true AS same_count {_KEPT}"),
    "delta_overwrite": Query(delta_overwrite, None, "SELECT load_no, count(*) AS n_rows FROM shop_orders GROUP BY load_no"),
    "arrow_ipc": Query(arrow_ipc, None, "SELECT count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(20,2)) AS total FROM shop_orders"),
    "partitioned_dataset": Query(partitioned_dataset, None, "SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_files FROM shipments"),
    "typed_pipeline": Query(typed_pipeline, None, "SELECT load_no, count(*) AS n_rows FROM shop_orders WHERE id > 100 GROUP BY load_no"),
    "generated_pipeline": Query(generated_pipeline, None, "SELECT o_orderstatus, count(o_orderkey) AS n_orders, max(o_totalprice) AS most FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus"),
}
QUERIES = {name: q.frame for name, q in ROUNDTRIPS.items()}
ORACLES = {name: q.other for name, q in ROUNDTRIPS.items()}

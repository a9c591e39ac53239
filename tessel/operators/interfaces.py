"""Queries through the library's interfaces: readers, stores, contracts, functions, batches and plans, each over whole tables."""

from __future__ import annotations

import contextlib
import io
import os
import runpy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import connectors
from ..codegen import PipelineSpec
from ..codegen.pipeline_source import pipeline_source
from ..codegen.source import contract_class
from ..contracts import Policy, conforms, contract, shape_from_spark, struct_type
from ..contracts.validate import INGEST, Validator
from ..functions.lookups import async_lookup
from ..functions.registry import register_functions
from ..functions.scalars import approx_equal, days_since_epoch
from ..pipeline import BatchPipeline
from ..plans import apply_rules, executed_operators, optimized, plan_tree, pushed_filters, read_columns
from ..plans.inspect import Spec
from ..publish import LocalStore, ObjectMeta, publish, publish_dataframe, read_completed, upload_from_temp
from ..scale import cut, scratch, shared_path
from ..session import PROFILES
from ..sources import csv, delta, flight, ipc
from ..sources.memory import MemoryProvider, register_sources
from ..sources.parquet import layout_report, read_ingest, write_single
from ..streaming.batches import batches_of, rows_of
from ..streaming.bounded import run_bounded_store
from ..streaming.budget import budgeted
from ..streaming.cancel import CancellationToken, Cancelled
from ..tables import table
from .catalogue import Query
from .roundtrips import _headers_csv, _plain


def with_settings(spark: SparkSession, settings: dict[str, str], make) -> DataFrame:
    """The result of ``make`` computed under ``settings``, which are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return cut(make())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _local_parquet(df: DataFrame, name: str) -> str:
    """``df`` as one Parquet file with a mounted path; for small results."""
    folder = os.path.join(shared_path(df.sparkSession), name)
    write_single(df, f"file://{folder}")
    return next(os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".parquet"))


# --- readers and writers


def rows_streamed(spark, d):
    """Ingest rows pulled one after the other; what is kept is bounded by one row."""
    n, notes = 0, 0
    for row in rows_of(csv.ingest_csv(spark, _headers_csv(spark, d))):
        n, notes = n + 1, notes + (row.note is not None)
    return spark.createDataFrame([(n, notes)], "n_rows bigint, n_notes bigint")


def csv_rows_by_callback(spark, d):
    def parse(record):
        return int(record["id"]), len(record["name"] or "")

    return csv.read_csv_rows(spark, _headers_csv(spark, d), ["id", "name", "note"], parse, "id bigint, n_signs int")


def csv_direct_and_rows(spark, d):
    """Whether batches that are filled by columns equal those made from rows, for every file of the ingest rows."""
    n, same = 0, True
    folder = _plain(_headers_csv(spark, d))
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".csv")):
        path = os.path.join(folder, name)
        for a, b in zip(csv.ingest_batches(path, 500), csv.ingest_batches(path, 500, direct=False), strict=True):
            n, same = n + a.num_rows, same and a.equals(b)
    return spark.createDataFrame([(n, same)], "n_rows bigint, same boolean")


def orders_csv_round_trip(spark, d):
    path = scratch(spark)
    o = table(spark, d, "shop_orders").where("id is not null and amount is not null and placed_at is not null")
    rows = o.select("id", "amount", F.date_format("placed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("placed_at"), F.coalesce("note", F.lit("")).alias("note"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = csv.orders_csv(spark, path)
    return back.agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(20,2)").alias("total"), F.count("note").alias("n_notes"), F.max("placed_at").alias("latest"))


def shipments_csv_round_trip(spark, d):
    path = scratch(spark)
    s = table(spark, d, "shipments").where("order_id is not null and carrier is not null and shipped_at is not null")
    rows = s.select("order_id", "carrier", F.date_format("shipped_at", "yyyy-MM-dd'T'HH:mm:ss").alias("shipped_at"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv.shipments_csv(spark, path).groupBy("carrier").agg(F.count("*").alias("n_rows"), F.max("shipped_at").alias("latest"))


def csv_column(spark, d):
    """The second column of the ingest rows, chosen by number."""
    return csv.select_column_df(spark, _headers_csv(spark, d), 1).groupBy("name").agg(F.count("*").alias("n_rows"))


def parquet_ingest(spark, d):
    path = scratch(spark)
    h = table(spark, d, "headers").where("id is not null and name is not null").select("id", "name", "note")
    write_single(h, path)
    return read_ingest(spark, path)


def parquet_layouts(spark, d):
    return layout_report(table(spark, d, "nation"), scratch(spark)).select("layout", "n_files", "n_rows", "with_stats")


def ipc_mapped(spark, d):
    folder = _plain(scratch(spark))
    ipc.write_ipc(table(spark, d, "shop_orders").select("load_no").where("load_no is not null").repartition(2), folder)
    parts = [ipc.mapped_int32(os.path.join(folder, f)) for f in sorted(os.listdir(folder))]
    total = sum(pa.compute.sum(c).as_py() or 0 for c, _ in parts)
    return spark.createDataFrame([(sum(len(c) for c, _ in parts), total, all(m for _, m in parts))], "n_rows bigint, total bigint, mapped boolean")


def flight_hand_over(spark, d):
    """A small table handed over by an Arrow Flight server and read back by its client."""
    server = flight.OrdersServer(table(spark, d, "nation"))
    try:
        return spark.createDataFrame(flight.fetch_orders(server.port))
    finally:
        server.shutdown()


@contract
class _Order:
    id: int | None
    note: str | None


def registered_tables(spark, d):
    """One contract over memory, Parquet, Delta and IPC; each is counted through the view it was registered as."""
    o = table(spark, d, "shop_orders").select("id", "note")
    paths = {"parquet": scratch(spark), "ipc": _plain(scratch(spark)), "delta": f"file://{_plain(scratch(spark))}"}
    o.write.parquet(paths["parquet"])
    ipc.write_ipc(o, paths["ipc"])
    delta.overwrite_delta(o, paths["delta"])
    for kind, path in paths.items():
        connectors.register(spark, _Order, f"reg_{kind}", path, kind)
    text = " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n_rows, count(note) AS n_notes FROM reg_{k}" for k in paths)
    return cut(spark.sql(text))


def memory_provider(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").toArrow()
    provider = MemoryProvider(spark, t.to_batches())
    provider.scan(["s_nationkey", "s_acctbal"]).createOrReplaceTempView("memory_suppliers")
    return cut(spark.sql("SELECT s_nationkey, count(*) AS n_suppliers FROM memory_suppliers WHERE s_acctbal > 0 GROUP BY s_nationkey"))


def object_by_store(spark, d):
    """A table read through a given store and in place: both are counted."""
    root = shared_path(spark)
    store = LocalStore(root)
    upload_from_temp(store, _local_parquet(table(spark, d, "shop_orders").select("id", "amount"), "orders"), "bucket/orders.parquet", part_bytes=64 << 10)
    connectors.register_from_store(spark, "store_orders", store, "bucket/orders.parquet")
    connectors.register_object(spark, "object_orders", f"file://{root}/bucket/orders.parquet")
    return cut(spark.sql("SELECT s.n AS by_store, o.n AS in_place, s.total FROM (SELECT count(*) AS n, CAST(sum(amount) AS DECIMAL(20,2)) AS total FROM store_orders) s JOIN (SELECT count(*) AS n FROM object_orders) o ON true"))


def counted_stream(spark, d):
    """Thirty-two counted batches through a streaming query, restarted from its checkpoint."""
    register_sources(spark)
    n = table(spark, d, "nation").count()
    out, check = scratch(spark), scratch(spark)
    stream = spark.readStream.format("tessel_counted").option("batches", 32).option("rows", n).load()
    for _ in range(2):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.parquet(out).agg(F.count("*").alias("n_rows"), F.countDistinct("batch").alias("n_batches"), F.countDistinct("id").alias("n_ids"))


# --- publication


def published_output(spark, d):
    """An output published to a store with its completion record and read back by that record."""
    root = shared_path(spark)
    store = LocalStore(root)
    df = table(spark, d, "shipments").groupBy("carrier").agg(F.count("*").alias("n_rows"))
    path = _local_parquet(df, "carriers")
    publish(store, path, "out/carriers.parquet", ObjectMeta("in", 1, "2026-01-01T00:00:00+00:00", "tag"), df.count(), "0" * 16)
    return read_completed(spark, store, "out/carriers.parquet")[0]


def published_folder(spark, d):
    path = _plain(scratch(spark))
    publish_dataframe(table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_customers")), path)
    return spark.read.parquet(path)


def bounded_store(spark, d):
    """CSV of a store to Parquet of the same store, with a record of what was read."""
    root = shared_path(spark)
    store = LocalStore(root)
    folder = _plain(_headers_csv(spark, d))
    first, data = True, []
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".csv")):
        with open(os.path.join(folder, name), "rb") as f:
            text = f.read()
        head, _, rest = text.partition(b"\n")
        data.append(text if first else rest)
        first = False
    store.put("in.csv", b"".join(data))
    report, manifest = run_bounded_store(spark, store, "in.csv", "out.parquet")
    back = read_completed(spark, store, "out.parquet")[0]
    return back.agg(F.count("*").alias("n_rows"), F.count("note").alias("n_notes")).withColumn("same", F.lit(report.rows == manifest.row_count) & (F.col("n_rows") == report.rows))


# --- contracts and generated code


def contract_policies(spark, d):
    """Which policies let a table with a column more, and one with a column less, stand for the ingest contract."""
    h = table(spark, d, "headers")
    shapes = {"more": shape_from_spark(h.schema), "less": shape_from_spark(h.select("id", "name").schema), "same": shape_from_spark(h.select("id", "name", "note").schema)}
    want = shape_from_spark(T.StructType([T.StructField(f.name, f.dataType, True) for f in INGEST]))
    rows = [(k, p.name, conforms(s, want, p)) for k, s in shapes.items() for p in Policy]
    return spark.createDataFrame(rows, "producer string, policy string, conforms boolean").groupBy("producer").agg(F.count_if("conforms").alias("n_policies"))


def contract_round_trip(spark, d):
    """The columns of a table by way of a generated contract class."""
    schema = table(spark, d, "manifests_v2").schema
    again = struct_type(contract_class(schema, "Generated"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), again[f.name].dataType == f.dataType) for f in schema], "column_name string, kind string, same boolean").select("column_name", "same")


def ingest_violation_counts(spark, d):
    return Validator(INGEST).violations(table(spark, d, "headers").select("id", "name", "note"))


def generated_program(spark, d):
    """A pipeline as generated program text, run as a program."""
    source, out = scratch(spark), scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_nationkey").write.parquet(source)
    ops = ("filter:c_nationkey,lt,10",)
    spec = PipelineSpec(f"parquet:{_plain(source)}", "Customer", out, source, "parquet", transform_df=ops)
    path = os.path.join(shared_path(spark), "generated.py")
    with open(path, "w", encoding="utf-8") as f:
        f.write(pipeline_source(spec))
    with contextlib.redirect_stdout(io.StringIO()):
        runpy.run_path(path, run_name="__main__")
    return spark.read.parquet(out)


def declared_schema(spark, d):
    """A Parquet table read under the schema that a declaration gives."""
    from ..codegen.declared import dbt_schema

    text = "models:\n  - name: nations\n    columns:\n      - {name: n_nationkey, data_type: bigint}\n      - {name: n_name, data_type: string}\n"
    names = [f.name for f in dbt_schema(text, "nations")]
    return table(spark, d, "nation").select(*names)


# --- functions


def sql_functions(spark, d):
    register_functions(spark)
    table(spark, d, "shop_orders").createOrReplaceTempView("fn_orders")
    return cut(spark.sql("SELECT id, load_no, days_since_epoch(placed_at) AS day, wrapping_add(load_no, 2147483647) AS wrapped, region_multiplier(id) AS multiplier, first_word(note) AS word FROM fn_orders WHERE load_no IS NOT NULL"))


def sql_amount_range(spark, d):
    register_functions(spark)
    table(spark, d, "shop_orders").createOrReplaceTempView("fn_orders")
    return cut(spark.sql("SELECT load_no, amount_range(amount) AS spread FROM fn_orders GROUP BY load_no"))


def function_and_builtin(spark, d):
    """Days by the function and by a plain expression, and whether the optimizer sees expressions in both."""
    o = table(spark, d, "shop_orders")
    plain = F.floor(F.unix_micros(F.col("placed_at").cast("timestamp")) / F.lit(86_400_000_000)).cast("bigint")
    one, two = o.select(days_since_epoch("placed_at").alias("x")), o.select(plain.alias("x"))
    inline = all("python" not in optimized(p).lower() and "udf" not in optimized(p).lower() for p in (one, two))
    both = o.select(days_since_epoch("placed_at").alias("a"), plain.alias("b"))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("n_equal")).withColumn("both_inline", F.lit(inline))


def looked_up_together(spark, d):
    async def half(key: int) -> float:
        return key / 2

    s = table(spark, d, "shop_orders").select("id", "load_no")
    return s.select("id", "load_no", async_lookup(half)("id").alias("half"))


def window_by_function(spark, d):
    """A window aggregate by an Arrow function over each group's whole frame."""
    import pandas as pd

    def spread(x):
        return float(x.max() - x.min())

    spread.__annotations__ = {"x": pd.Series, "return": float}
    spread = F.pandas_udf(spread, "double")
    return table(spark, d, "part").select("p_partkey", F.round(spread("p_retailprice").over(Window.partitionBy("p_brand")), 4).alias("spread"))


def near_sums(spark, d):
    """Groups whose sums in two orders of adding are equal within a relative distance."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("a"), F.sum(F.col("l_extendedprice").cast("decimal(20,4)")).cast("double").alias("b"))
    return li.select("l_returnflag", approx_equal("a", "b").alias("near"))


def hand_over(spark, d):
    """A small column handed over in Arrow form and by way of rows: the same sum."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("v"))
    whole, rows = s.toArrow(), [tuple(r) for r in s.collect()]
    a, b = spark.createDataFrame(whole), spark.createDataFrame(rows, "v bigint")
    return a.agg(F.sum("v").alias("by_arrow")).join(b.agg(F.sum("v").alias("by_rows")))


# --- batches, budgets, cancellation


def batches_in_order(spark, d):
    """Batches of at most 1,000 ordered rows: their number, size and ends."""
    df = table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey")
    rows = [(k, b.num_rows, b.column(0)[0].as_py(), b.column(0)[-1].as_py()) for k, b in enumerate(batches_of(df, 1000))]
    return spark.createDataFrame(rows, "batch bigint, n_rows bigint, first_key bigint, last_key bigint")


def first_batch_only(spark, d):
    """A consumer that stops after the first batch of a sorted result."""
    first = next(batches_of(table(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")), 10))
    return spark.createDataFrame(pa.Table.from_batches([first]))


def batches_under_budget(spark, d):
    h = table(spark, d, "headers").select("id", "name", "note")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])
    df, seen = budgeted(h, lambda b: b, schema, 64 << 20)
    n = cut(df.agg(F.count("*").alias("n_rows"), F.count("name").alias("n_names")))
    return n.withColumn("within", F.lit(0 < seen["peak"].value <= 64 << 20 and seen["batches"].value > 0))


def batch_pipeline(spark, d):
    @contract
    class Nation:
        n_nationkey: int
        n_name: str

    kept = []
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    report = BatchPipeline(Nation, lambda: (b.cast(pa.schema([pa.field("n_nationkey", pa.int64(), False), pa.field("n_name", pa.string(), False)])) for b in batches_of(nations, 10)), [], Nation, kept.append).run()
    return spark.createDataFrame([(report.rows_processed, report.batches_processed, sum(b.num_rows for b in kept))], "n_rows bigint, n_batches bigint, n_kept bigint")


def cancelled_before_it_starts(spark, d):
    token = CancellationToken()
    token.cancel()
    try:
        token.check()
        done = table(spark, d, "nation").count()
    except Cancelled:
        done = 0
    return spark.createDataFrame([(token.cancelled, done)], "cancelled boolean, n_rows bigint")


# --- plans and settings


def aggregate_that_spills(spark, d):
    """Sets by order, with aggregation forced to sort and spill from the second group on."""
    make = lambda: table(spark, d, "shipments").groupBy("order_id").agg(F.size(F.collect_set("carrier")).alias("n_carriers"), F.count("*").alias("n_rows"))
    return with_settings(spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1"}, make)


def window_that_spills(spark, d):
    """A running count in each carrier, with frames kept on disk beyond 64 rows."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    make = lambda: table(spark, d, "orders").select("o_orderkey", F.sum("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_keys"))
    return with_settings(spark, {"spark.sql.windowExec.buffer.in.memory.threshold": "8", "spark.sql.windowExec.buffer.spill.threshold": "64"}, make)


def one_and_many_partitions(spark, d):
    """The join aggregate with one shuffle partition and with many: the same result."""

    def make() -> DataFrame:
        o, s = table(spark, d, "shop_orders").select("id", "amount"), table(spark, d, "shipments").select("order_id")
        return o.join(s, o["id"] == s["order_id"]).agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(22,2)").alias("total"))

    rows = [with_settings(spark, {"spark.sql.shuffle.partitions": n}, make).first() for n in ("1", "37")]
    return spark.createDataFrame([(rows[0].n_rows, rows[0].total, rows[0] == rows[1])], "n_rows bigint, total decimal(22,2), same boolean")


def profile_of_settings(spark, d):
    """A join under the profile without broadcasts, with the operator it ran."""

    def make() -> DataFrame:
        a, b = table(spark, d, "nation"), table(spark, d, "region")
        df = a.join(b, a["n_regionkey"] == b["r_regionkey"]).groupBy("r_name").agg(F.count("*").alias("n"))
        df.collect()
        return df.withColumn("merged", F.lit("SortMergeJoin" in executed_operators(df)))

    return with_settings(spark, PROFILES["no_broadcast"], make)


def plan_rewrite(spark, d):
    """The plan that a join aggregate really ran: its result, whether filters and columns reached the scans, and how many of its
    operators the replacement rules take."""
    o, s = table(spark, d, "shop_orders"), table(spark, d, "shipments")
    df = o.where(F.col("amount") > 50).join(s, F.col("id") == F.col("order_id")).agg(F.count("*").alias("n_rows"), F.sum("amount").cast("decimal(22,2)").alias("total"))
    row = df.first()
    plan = plan_tree(df)
    specs = [Spec(name, (), f"Native{name}") for name in ("HashAggregate", "Project", "Filter")]
    before, after = plan.names(), apply_rules(plan, specs).names()
    taken = sum(a != b for a, b in zip(before, after))
    known = sum(n in ("HashAggregate", "Project", "Filter") for n in before)
    scans = any("amount" in f for f in pushed_filters(df)) and set(read_columns(df)) == {"id", "amount", "order_id"}
    out = [(row.n_rows, row.total, taken == known > 0 and len(before) == len(after), apply_rules(plan, []) == plan, scans)]
    return spark.createDataFrame(out, "n_rows bigint, total decimal(22,2), all_known_replaced boolean, others_kept boolean, pushed_down boolean")


def window_plan(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("bigint").alias("k"))
    return df.withColumn("has_window", F.lit("Window" in optimized(df)))


_SAVED = "(SELECT id, name, note FROM headers WHERE id IS NOT NULL AND name IS NOT NULL)"
_BOTH = "SELECT count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(22,2)) AS total, {0} FROM shop_orders JOIN shipments ON id = order_id"
INTERFACES: dict[str, Query] = {
    "rows_streamed": Query(rows_streamed, None, f"SELECT count(*) AS n_rows, count(nullif(note, '')) AS n_notes FROM {_SAVED}"),
    "csv_rows_by_callback": Query(csv_rows_by_callback, None, f"SELECT id, CAST(length(name) AS INT) AS n_signs FROM {_SAVED}"),
    "csv_direct_and_rows": Query(csv_direct_and_rows, None, f"SELECT count(*) AS n_rows, true AS same FROM {_SAVED}"),
    "orders_csv_round_trip": Query(orders_csv_round_trip, None, "SELECT count(*) AS n_rows, CAST(sum(amount) AS DECIMAL(20,2)) AS total, count(nullif(note, '')) AS n_notes, max(date_trunc('second', placed_at)) AS latest FROM shop_orders WHERE id IS NOT NULL AND amount IS NOT NULL AND placed_at IS NOT NULL"),
    "shipments_csv_round_trip": Query(shipments_csv_round_trip, None, "SELECT carrier, count(*) AS n_rows, max(date_trunc('second', shipped_at)) AS latest FROM shipments WHERE order_id IS NOT NULL AND carrier IS NOT NULL AND shipped_at IS NOT NULL GROUP BY carrier"),
    "csv_column": Query(csv_column, None, f"SELECT name, count(*) AS n_rows FROM {_SAVED} GROUP BY name"),
    "parquet_ingest": Query(parquet_ingest, None, f"SELECT * FROM {_SAVED}"),
    "parquet_layouts": Query(parquet_layouts, None, "SELECT l.layout, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows, true AS with_stats FROM nation, (VALUES ('snappy'), ('zstd'), ('snappy_small_groups')) l(layout) GROUP BY l.layout"),
    "ipc_mapped": Query(ipc_mapped, None, "SELECT count(*) AS n_rows, CAST(sum(load_no) AS BIGINT) AS total, true AS mapped FROM shop_orders WHERE load_no IS NOT NULL"),
    "flight_hand_over": Query(flight_hand_over, None, "SELECT * FROM nation"),
    "registered_tables": Query(registered_tables, None, "SELECT k.kind, count(*) AS n_rows, count(note) AS n_notes FROM shop_orders, (VALUES ('parquet'), ('ipc'), ('delta')) k(kind) GROUP BY k.kind"),
    "memory_provider": Query(memory_provider, None, "SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey"),
    "object_by_store": Query(object_by_store, None, "SELECT count(*) AS by_store, count(*) AS in_place, CAST(sum(amount) AS DECIMAL(20,2)) AS total FROM shop_orders"),
    "counted_stream": Query(counted_stream, None, "SELECT 32 * count(*) AS n_rows, CAST(32 AS BIGINT) AS n_batches, 32 * count(*) AS n_ids FROM nation"),
    "published_output": Query(published_output, None, "SELECT carrier, count(*) AS n_rows FROM shipments GROUP BY carrier"),
    "published_folder": Query(published_folder, None, "SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY c_nationkey"),
    "bounded_store": Query(bounded_store, None, f"SELECT count(*) AS n_rows, count(nullif(note, '')) AS n_notes, true AS same FROM {_SAVED}"),
    "contract_policies": Query(contract_policies, None, "SELECT * FROM (VALUES ('more', CAST(2 AS BIGINT)), ('less', CAST(3 AS BIGINT)), ('same', CAST(8 AS BIGINT))) t(producer, n_policies)"),
    "contract_round_trip": Query(contract_round_trip, None, "SELECT column_name, true AS same FROM (DESCRIBE manifests_v2)"),
    "ingest_violation_counts": Query(ingest_violation_counts, None, "SELECT 'id' AS path, count(*) - count(id) AS n_rows FROM headers UNION ALL SELECT 'name', count(*) - count(name) FROM headers"),
    "generated_program": Query(generated_program, None, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10"),
    "declared_schema": Query(declared_schema, None, "SELECT n_nationkey, n_name FROM nation"),
    "sql_functions": Query(sql_functions, None, "SELECT id, load_no, CAST(date_diff('day', DATE '1970-01-01', CAST(placed_at AS DATE)) AS BIGINT) AS day, CAST(CAST(load_no AS BIGINT) + 2147483647 - CASE WHEN load_no > 0 THEN 4294967296 ELSE 0 END AS INT) AS wrapped, CASE WHEN id IS NULL THEN NULL WHEN id IN (1, 4, 8) THEN 1.5::DOUBLE WHEN id IN (5, 6) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS multiplier, split_part(note, ' ', 1) AS word FROM shop_orders WHERE load_no IS NOT NULL"),
    "sql_amount_range": Query(sql_amount_range, None, "SELECT load_no, CAST(max(amount) - min(amount) AS DECIMAL(11,2)) AS spread FROM shop_orders GROUP BY load_no"),
    "function_and_builtin": Query(function_and_builtin, None, "SELECT count(*) AS n_rows, count(*) AS n_equal, true AS both_inline FROM shop_orders"),
    "looked_up_together": Query(looked_up_together, None, "SELECT id, load_no, id / 2.0::DOUBLE AS half FROM shop_orders"),
    "window_by_function": Query(window_by_function, None, "SELECT p_partkey, round(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 4) AS spread FROM part WINDOW w AS (PARTITION BY p_brand)"),
    "near_sums": Query(near_sums, None, "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag"),
    "hand_over": Query(hand_over, None, "SELECT CAST(sum(s_suppkey) AS BIGINT) AS by_arrow, CAST(sum(s_suppkey) AS BIGINT) AS by_rows FROM supplier"),
    "batches_in_order": Query(batches_in_order, None, "SELECT (k - 1) // 1000 AS batch, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1"),
    "first_batch_only": Query(first_batch_only, None, "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10"),
    "batches_under_budget": Query(batches_under_budget, None, "SELECT count(*) AS n_rows, count(name) AS n_names, true AS within FROM headers"),
    "batch_pipeline": Query(batch_pipeline, None, "SELECT count(*) AS n_rows, (count(*) + 9) // 10 AS n_batches, count(*) AS n_kept FROM nation"),
    "cancelled_before_it_starts": Query(cancelled_before_it_starts, None, "SELECT true AS cancelled, count(*) - count(*) AS n_rows FROM nation"),
    "aggregate_that_spills": Query(aggregate_that_spills, None, "SELECT order_id, CAST(count(DISTINCT carrier) AS INT) AS n_carriers, count(*) AS n_rows FROM shipments GROUP BY order_id"),
    "window_that_spills": Query(window_that_spills, None, "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT) AS all_keys FROM orders"),
    "one_and_many_partitions": Query(one_and_many_partitions, None, _BOTH.format("true AS same")),
    "profile_of_settings": Query(profile_of_settings, None, "SELECT r_name, count(*) AS n, true AS merged FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "plan_rewrite": Query(plan_rewrite, None, _BOTH.format("true AS all_known_replaced, true AS others_kept, true AS pushed_down") + " WHERE amount > 50"),
    "window_plan": Query(window_plan, None, "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k, true AS has_window FROM part"),
}
QUERIES = {name: q.frame for name, q in INTERFACES.items()}
ORACLES = {name: q.other for name, q in INTERFACES.items()}

import os
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel import connectors
from tessel.contracts import I32, ContractViolation, contract
from tessel.plans import pushed_filters, read_columns
from tessel.sources import (
    footers, ingest_csv, layout_report, memory_table, orders_csv, overwrite_delta, read_delta, read_ingest, read_ipc, register_sources, select_column, split_records, write_ipc,
    write_partitioned, write_single,
)
from tessel.sources.csv import CsvError, checked, first_bad_row, select_column_df
from tessel.sources.ipc import mapped_int32, read_ipc_table
from tessel.sources.memory import packed
from tessel.sources.parquet import LAYOUTS

HEADERS = 'id,name,note\n1,Ada,"quoted, comma"\n2,Zoë,"line one\nline two"\n3,,""\n'


@pytest.fixture
def csv_file(tmp_path):
    def write(text, name="x.csv"):
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
        return str(tmp_path / name)

    return write


def test_ingest(spark, csv_file):
    rows = [tuple(r) for r in ingest_csv(spark, csv_file(HEADERS)).orderBy("id").collect()]
    assert rows == [(1, "Ada", "quoted, comma"), (2, "Zoë", "line one\nline two"), (3, "", None)]
    assert ingest_csv(spark, csv_file("id,name,note\n")).collect() == []


@pytest.mark.parametrize(("text", "row"), [("id,name,note\n1,Ada,\n2\n", 1), ("id,name,note\n1,Ada,x,y\n", 0), ("id,name,note\n1,a,b\n2,a,b\nx,a,b\n", 2), ("id,name,note\n9223372036854775808,a,b\n", 0)])
def test_malformed_rows_are_named(spark, csv_file, text, row):
    path = csv_file(text)
    with pytest.raises(CsvError) as e:
        checked(ingest_csv(spark, path), path, 3)
    assert e.value.row == row
    assert first_bad_row(csv_file(HEADERS), 3) is None


def test_orders(spark, csv_file):
    head = "id,amount,placed_at,note\n"
    r = orders_csv(spark, csv_file(head + '1,-0.01,2026-01-05T10:00:00,""\n')).first()
    assert (r.amount, r.note, str(r.placed_at)) == (Decimal("-0.01"), None, "2026-01-05 10:00:00")
    for bad in ("1,1.2,2026-01-05T10:00:00,", "1,100000000.00,2026-01-05T10:00:00,", "1,1.00,2026-02-30T10:00:00,", "1,1.00,2026-01-05 10:00:00,"):
        with pytest.raises(Exception, match="bad (amount|placed_at)"):
            orders_csv(spark, csv_file(head + bad + "\n")).collect()


def test_select_column(spark, csv_file):
    path = csv_file(HEADERS)
    assert list(select_column(path, 1)) == ["name\n", "Ada\n", "Zoë\n", '""\n']
    assert list(select_column(path, 2)) == ["note\n", '"quoted, comma"\n', '"line one\nline two"\n', '""\n']
    assert [r[0] for r in select_column_df(spark, path, 1).collect()] == ["Ada", "Zoë", ""]
    assert list(select_column(csv_file("10,alpha\n11,beta\n", "plain.csv"), 1, headers=False)) == ["alpha\n", "beta\n"]
    for column in (3, -1):
        with pytest.raises(ValueError):
            select_column(path, column)
    lines = select_column(csv_file("a,b\n1,2\n3\n", "short.csv"), 1)
    assert next(lines) == "b\n" and next(lines) == "2\n"
    with pytest.raises(CsvError):
        next(lines)


def test_split_records():
    rows = split_records("a,b\r\n\n雨,\n".encode())
    assert [[bytes(f).decode() for f in r] for r in rows] == [["a", "b"], ["雨", ""]]
    assert split_records(b"\xff,1") is None and split_records(b"") == []
    assert rows[0][0].obj is not None


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None)], "id bigint, name string, note string")
    write_single(df, str(tmp_path / "one"))
    assert read_ingest(spark, str(tmp_path / "one")).collect() == df.collect()
    write_single(df.withColumn("id", F.col("id").cast("int")), str(tmp_path / "drift"), "zstd")
    with pytest.raises(ContractViolation):
        read_ingest(spark, str(tmp_path / "drift"))
    write_partitioned(spark.range(1000), str(tmp_path / "many"), 4, rows_per_file=100)
    found = footers(spark, str(tmp_path / "many")).collect()
    assert len(found) >= 8 and sum(r.n_rows for r in found) == 1000 and all(r.with_stats for r in found)
    report = {r.layout: r for r in layout_report(spark.range(200_000).coalesce(1), str(tmp_path / "layouts")).collect()}
    assert set(report) == set(LAYOUTS) and all(r.n_rows == 200_000 for r in report.values())
    assert report["snappy_small_groups"].n_groups >= report["snappy"].n_groups


def test_pushdown(spark, tmp_path):
    spark.range(4096).select("id", F.when(F.col("id") % 17 != 0, F.col("id")).alias("amount"), F.lit("n").alias("note")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).where("amount >= 4000").select("id")
    assert "GreaterThanOrEqual(amount,4000)" in pushed_filters(df) and set(read_columns(df)) == {"id", "amount"}
    assert sorted(r.id for r in df.collect()) == [k for k in range(4000, 4096) if k % 17]


def test_memory(spark):
    t = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    assert memory_table(spark, t, "mem").count() == spark.table("mem").count() == 3
    register_sources(spark)
    reader = spark.read.format("tessel_memory").option("data", packed(t)).option("parts", 2)
    assert sorted(map(tuple, reader.load().where("a > 1").collect())) == [(2, None), (3, "z")]
    narrow = spark.read.format("tessel_memory").option("data", packed(t)).option("columns", "b").load()
    assert narrow.columns == ["b"] and narrow.count() == 3
    assert spark.read.format("tessel_memory").option("data", packed(t.slice(0, 0))).load().count() == 0


def test_ipc(spark, tmp_path):
    d = str(tmp_path / "ipc")
    df = spark.range(1000).select(F.col("id").cast("int").alias("n"), (F.col("id") * 2).alias("twice"))
    write_ipc(df.repartition(3), d)
    assert sorted(os.listdir(d)) == [f"part-{k:05d}.arrow" for k in range(3)]
    assert read_ipc(spark, d).agg(F.sum("twice")).first()[0] == 999_000
    assert read_ipc(spark, d, ["n"]).columns == ["n"]
    write_ipc(df.select("n").coalesce(1), str(tmp_path / "one"))
    path = str(tmp_path / "one" / "part-00000.arrow")
    column, zero_copy = mapped_int32(path)
    assert zero_copy and len(column) == 1000 and read_ipc_table(path, ["n"]).num_rows == 1000
    with pytest.raises(TypeError):
        mapped_int32(os.path.join(d, "part-00000.arrow"))


def test_delta(spark, tmp_path):
    uri = f"file://{tmp_path}/delta"
    assert overwrite_delta(spark.range(5), uri) == 0
    assert overwrite_delta(spark.range(3).withColumn("x", F.lit("a")), uri) == 1
    df = read_delta(spark, uri)
    assert df.count() == 3 and df.columns == ["id", "x"]
    with pytest.raises(FileNotFoundError):
        read_delta(spark, f"file://{tmp_path}/none")


def test_connectors(spark, tmp_path, csv_file):
    @contract
    class Order:
        id: int
        quantity: I32
        note: "str | None"

    table = pa.table({"id": pa.array([1, 2]), "quantity": pa.array([5, -1], pa.int32()), "note": ["a", None]})
    assert connectors.register_memory(spark, Order, "t1", table).where(Order.c.quantity > 0).count() == 1
    df = spark.table("t1")
    df.write.parquet(str(tmp_path / "ok"))
    df.drop("note").write.parquet(str(tmp_path / "missing"))
    df.withColumn("quantity", F.col("quantity").cast("bigint")).write.parquet(str(tmp_path / "typed"))
    assert connectors.register(spark, Order, "t2", str(tmp_path / "ok"), "parquet").count() == 2
    assert connectors.register_parquet(spark, Order, "t2", str(tmp_path / "ok"), every_file=True).count() == 2
    for bad in ("missing", "typed"):
        with pytest.raises(ContractViolation):
            connectors.register_parquet(spark, Order, "t3", str(tmp_path / bad))
    assert connectors.register(spark, Order, "t4", csv_file("id,quantity,note\n1,2,x\n"), "csv").first().quantity == 2
    with pytest.raises(Exception):
        connectors.register_csv(spark, Order, "t5", csv_file("id,quantity,note\n1,x,x\n", "bad.csv")).collect()
    overwrite_delta(df, f"file://{tmp_path}/d")
    assert connectors.register(spark, Order, "t6", f"file://{tmp_path}/d", "delta").count() == 2
    assert connectors.register_object(spark, "t7", f"file://{tmp_path}/ok").count() == 2


def test_flight(spark):
    flight = pytest.importorskip("pyarrow.flight")
    from tessel.sources.flight import OrdersServer, fetch_orders

    with OrdersServer(spark.range(5)) as server:
        assert fetch_orders(server.port).num_rows == 5
        with pytest.raises(flight.FlightError):
            fetch_orders(server.port, b"other")


def test_plain_csv_is_split_and_multi_line_csv_is_not(spark, tmp_path):
    from tessel.sources import csv

    plain, deep = tmp_path / "plain.csv", tmp_path / "deep.csv"
    plain.write_text("id,name,note\n" + "".join(f'{k},"n ""{k}""",x\n' for k in range(20_000)))
    deep.write_text('id,name,note\n1,"a\nb",x\n2,c,\n')
    assert not csv.records_span_lines(spark, str(plain)) and csv.records_span_lines(spark, str(deep))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = csv.ingest_csv(spark, str(plain))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20_000 and df.where("name = 'n \"7\"'").first().id == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in csv.ingest_csv(spark, str(deep)).collect()] == [(1, "a\nb", "x"), (2, "c", None)]


@pytest.mark.parametrize("direct", [True, False])
def test_batches_from_records(tmp_path, direct):
    from tessel.sources.csv import CsvError, ingest_batches

    path = tmp_path / "x.csv"
    path.write_text('id,name,note\n1,a,\n2,,"n\nm"\n3,c,d\n')
    got = [b.to_pylist() for b in ingest_batches(str(path), 2, direct)]
    assert [len(b) for b in got] == [2, 1] and got[0] == [{"id": 1, "name": "a", "note": None}, {"id": 2, "name": "", "note": "n\nm"}]
    assert next(ingest_batches(str(path), 1, direct)).num_rows == 1
    path.write_text("id,name,note\n1,a,b\nx,y,z\n")
    seen = []
    with pytest.raises(CsvError) as e:
        seen.extend(ingest_batches(str(path), 5, direct))
    assert e.value.row == 1
    # the rows before the bad one still come
    assert [b.num_rows for b in seen] == [1]
    path.write_text("id,name,note\n")
    assert list(ingest_batches(str(path), 5, direct)) == []


def test_memory_provider_reads_the_columns_asked_for(spark):
    import pyarrow as pa

    from tessel.sources.memory import MemoryProvider

    t = pa.table({"id": [1, 2, 3], "name": ["a", None, "c"], "x": [1.5, 2.5, None]})
    p = MemoryProvider(spark, t.to_batches(max_chunksize=2))
    assert p.scan(["x", "id"]).columns == ["x", "id"] and [tuple(r) for r in p.scan(["x", "id"]).where("id > 1").orderBy("id").collect()] == [(2.5, 2), (None, 3)]
    assert p.scan().count() == 3
    with pytest.raises(KeyError):
        p.scan(["none"])
    assert MemoryProvider(spark, [], t.schema).scan(["id"]).collect() == []

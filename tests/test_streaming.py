import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.publish import LocalStore, read_completed
from tessel.sources.csv import CsvError
from tessel.streaming import (
    BatchGrowthExceedsBudget, BatchTooLarge, BoundedConfig, ByteBudget, ByteChargeOverflow, CancellationToken, Cancelled, batches_of, event_windows, ingest_stream, rows_of, run_bounded,
    run_bounded_store, session_windows, stateful_totals,
)
from tessel.streaming.bounded import naive_csv_to_parquet

TEXT = 'id,name,note\n1,Ada,"quoted, comma"\n2,Zoë,\n3,,""\n'


@pytest.fixture
def source(tmp_path):
    (tmp_path / "in.csv").write_text(TEXT, encoding="utf-8")
    return str(tmp_path / "in.csv")


def test_bounded(spark, source, tmp_path):
    out = str(tmp_path / "out")
    r = run_bounded(spark, source, out)
    assert r.rows == 3 and spark.read.parquet(out).count() == 3
    again = run_bounded(spark, source, str(tmp_path / "again"), BoundedConfig(batch_rows=1), transform=lambda b: b)
    assert again.digest == r.digest and again.batches >= 3 and again.peak_bytes > 0
    naive_csv_to_parquet(spark, source, str(tmp_path / "naive"))
    assert spark.read.parquet(str(tmp_path / "naive")).exceptAll(spark.read.parquet(out)).count() == 0


def test_nothing_is_published_after_a_failure(spark, source, tmp_path):
    out = str(tmp_path / "out")
    run_bounded(spark, source, out)
    (tmp_path / "bad.csv").write_text("id,name,note\n1,a,b\n2\n")
    with pytest.raises(CsvError) as e:
        run_bounded(spark, str(tmp_path / "bad.csv"), out)
    assert e.value.row == 1

    def null_names(b):
        return pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string()), b.column(2)], schema=b.schema)

    def grow(b):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(["x" * 100_000] * b.num_rows), b.column(2)], schema=b.schema)

    for config, transform, text in (
        (BoundedConfig(), null_names, "path <name>"), (BoundedConfig(byte_budget=10), lambda b: b, "BatchTooLarge"), (BoundedConfig(byte_budget=5_000), grow, "BatchGrowthExceedsBudget"),
    ):
        with pytest.raises(Exception, match=text):
            run_bounded(spark, source, out, config, transform)
    token = CancellationToken()
    token.cancel()
    with pytest.raises(Cancelled):
        run_bounded(spark, source, out, cancel=token)
    assert spark.read.parquet(out).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["bad.csv", "in.csv", "out"]


def test_cancel_while_running(spark, source, tmp_path):
    token = CancellationToken()

    def late(df, path, veto):
        token.cancel()
        veto()

    with pytest.raises(Cancelled):
        run_bounded(spark, source, str(tmp_path / "out"), cancel=token, publish_to=late)
    ended = threading.Event()

    def slow():
        try:
            with CancellationToken().jobs(spark):
                pass
            with second.jobs(spark):
                spark.range(0, 4 * 10**10, 1, 2).selectExpr("sum(id % 7)").collect()
        except Exception:
            ended.set()

    second = CancellationToken()
    t = threading.Thread(target=slow, daemon=True)
    t.start()
    import time

    for _ in range(100):
        time.sleep(0.1)
        if second._sessions:
            break
    time.sleep(1)
    second.cancel()
    assert ended.wait(30)


def test_bounded_store(spark, source, tmp_path):
    store = LocalStore(tmp_path / "store")
    store.put_file(source, "in/a.csv")
    report, manifest = run_bounded_store(spark, store, "in/a.csv", "out/a.parquet")
    assert manifest.row_count == report.rows == 3 and manifest.content_digest == report.digest and manifest.input_key == "in/a.csv"
    df, _ = read_completed(spark, store, "out/a.parquet")
    assert df.count() == 3


def test_budget():
    b = ByteBudget(100)
    b.admit(60)
    with pytest.raises(BatchTooLarge):
        b.admit(101)
    with pytest.raises(BatchTooLarge):
        b.admit(41)
    b.grow(60, 30)
    assert b.current == 60
    with pytest.raises(BatchGrowthExceedsBudget):
        b.grow(60, 101)
    b.grow(60, 100)
    assert (b.current, b.peak) == (100, 100)
    b.release(100)
    assert b.current == 0
    with pytest.raises(ByteChargeOverflow):
        ByteBudget(1 << 70, current=(1 << 63) - 1).admit(1)
    for bad in ({"batch_rows": 0}, {"byte_budget": 0}):
        with pytest.raises(ValueError):
            BoundedConfig(**bad)


def test_batches_in_order(spark):
    df = spark.range(0, 1000, 1, 7).orderBy(F.desc("id"))
    sizes, values = zip(*((b.num_rows, b.column(0).to_pylist()) for b in batches_of(df, 300)))
    assert sizes == (300, 300, 300, 100) and sum(values, []) == list(range(999, -1, -1))
    assert next(rows_of(df)).id == 999 and list(batches_of(spark.range(0), 5)) == []
    with pytest.raises(ValueError):
        next(batches_of(df, 0))
    failing = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("broken read"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="broken read"):
        list(rows_of(failing))


def test_event_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))

    def result(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("out").collect()

    want = {tuple(r) for r in event_windows(events).collect()}
    got = {tuple(r) for r in result(event_windows(stream()), "complete")}
    near = lambda rows: {(*r[:3], round(r[3], 6)) for r in rows}
    assert near(got) == near(want) and want
    sliding = event_windows(events, "2 hours", "1 hour").agg(F.sum("n_events")).first()[0]
    assert sliding == 2 * events.count()
    sessions = session_windows(events)
    assert sessions.agg(F.sum("n_events")).first()[0] == events.count()
    totals = result(stateful_totals(stream()), "update")
    assert sum(r.n_events for r in totals) == events.where("user_id is not null").count()


def test_ingest_stream(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "src"))
    seen = []
    q = ingest_stream(spark, str(tmp_path / "src"), spark.range(1).schema, lambda df, n: seen.append(df.count()), str(tmp_path / "check"), files_per_trigger=1)
    q.awaitTermination()
    assert sum(seen) == 10 and len(seen) == 3

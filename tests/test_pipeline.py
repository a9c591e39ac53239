import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.contracts import Char, ContractMismatch, I32, contract
from tessel.pipeline import BatchPipeline, Pipeline, PipelineError, RunReport, write_parquet_sink


@contract
class Order:
    id: int
    quantity: I32


@contract
class Total:
    total: "int | None"


@contract
class Odd:
    x: Char


ROWS = [(1, 5), (2, -1), (3, 10)]


def orders(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id bigint, quantity int")


def collect_into(out):
    return lambda df: out.extend(df.collect())


def test_filter_and_sum(spark):
    out = []
    p = Pipeline(spark).source(Order, lambda: orders(spark))
    p = p.transform(Order, Order, lambda df: df.where("quantity > 0")).sql_transform(Total, "SELECT sum(quantity) AS total FROM batch")
    assert p.sink(Total, collect_into(out)).build().run() == RunReport(1, 1) and out[0].total == 15


def test_transform_sees_all_rows_at_once(spark, tmp_path):
    df = orders(spark, [(k, 1) for k in range(1000)]).repartition(9)
    path = str(tmp_path / "out")
    p = Pipeline(spark).source(Order, lambda: df).df_transform(Total, lambda d: d.agg(F.sum("quantity").alias("total")))
    p.sink(Total, write_parquet_sink(path)).build().run()
    assert [r.total for r in spark.read.parquet(path).collect()] == [1000]


def test_connections_are_checked_at_once(spark):
    p = Pipeline(spark).source(Order, lambda: orders(spark))
    with pytest.raises(ContractMismatch):
        p.sink(Total, print)
    with pytest.raises(ContractMismatch):
        p.transform(Total, Order, lambda d: d)
    with pytest.raises(TypeError):
        Pipeline(spark).sink(Order, print)
    with pytest.raises(TypeError):
        p.source(Order, lambda: None)


def test_declarations_are_mapped_before_the_source_opens(spark):
    opened = []
    p = Pipeline(spark).source(Odd, lambda: opened.append(1)).sink(Odd, print)
    with pytest.raises(PipelineError) as e:
        p.build()
    assert (e.value.stage, e.value.kind, e.value.batch_index, opened) == ("Source", "Mapping", None, [])


def test_stages_of_failures(spark, tmp_path):
    def run(make, step=lambda d: d, sink=lambda d: d.collect()):
        with pytest.raises(PipelineError) as e:
            Pipeline(spark).source(Order, make).df_transform(Order, step).sink(Order, sink).build().run()
        return e.value.stage, e.value.kind

    def fail(*_):
        raise RuntimeError("no")

    assert run(fail) == ("SourceFactory", "Callback")
    assert run(lambda: spark.range(3)) == ("Source", "Validation")
    assert run(lambda: orders(spark, [(None, 1)])) == ("Source", "Validation")
    assert run(lambda: orders(spark), fail) == ("Transform(0)", "Callback")
    assert run(lambda: orders(spark), lambda d: d.withColumn("id", F.lit(None).cast("bigint"))) == ("Transform(0)", "Validation")
    assert run(lambda: orders(spark), sink=fail) == ("Sink", "Callback")


def test_a_violation_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = Pipeline(spark).source(Order, lambda: orders(spark)).sink(Order, write_parquet_sink(path)).build()
    assert good.run() == RunReport(1, 3)
    with pytest.raises(PipelineError):
        Pipeline(spark).source(Order, lambda: orders(spark, [(1, 1), (None, 1)])).sink(Order, write_parquet_sink(path)).build().run()
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]


SCHEMA = pa.schema([pa.field("id", pa.int64(), False), pa.field("quantity", pa.int32(), False)])


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], schema=SCHEMA)


def test_batches():
    seen = []
    run = lambda batches, steps=(), sink=seen.append: BatchPipeline(Order, lambda: batches, list(steps), Order, sink).run()
    assert run([]) == RunReport(0, 0) and not seen
    assert run([batch([])]) == RunReport(1, 0) and len(seen) == 1
    assert run([batch(ROWS), batch(ROWS[:1])]) == RunReport(2, 4)

    def broken():
        yield batch(ROWS)
        raise OSError("gone")

    def lie(b):
        return pa.RecordBatch.from_arrays([b.column(0)], names=["id"])

    for source, steps, want in ((broken(), (), ("Source", "Callback", 1)), ([batch(ROWS)], [(Order, lie)], ("Transform(0)", "Validation", 0)), ([batch([(None, 1)])], (), ("Source", "Validation", 0))):
        seen.clear()
        with pytest.raises(PipelineError) as e:
            run(source, steps)
        assert (e.value.stage, e.value.kind, e.value.batch_index) == want
        assert len(seen) == want[2]

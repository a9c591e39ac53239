import subprocess
import sys

import pytest
from pyspark.sql import types as T

from tessel.codegen import PipelineSpec, SchemaError, Sort, apply_ops, contract_class, dbt_schema, erwin_schema, parse_literal, parse_op, parse_spec, pipeline_source, struct_source
from tessel.codegen import cli
from tessel.codegen.declared import resolve_schema
from tessel.codegen.gate import check_gate
from tessel.contracts import ContractMismatch, contract, shape_of, struct_type
from tessel.sources import overwrite_delta

# The forms of declarations, and below the names of errors, which callers tell apart.
DBT = """
models:
  - name: orders
    columns:
      - {name: id, data_type: bigint, tests: [not_null]}
      - {name: region, data_type: string, tests: [{not_null: {severity: warn}}]}
      - {name: quantity, data_type: INT, tests: [unique, not_null]}
      - {name: customer, data_type: "struct<name:string,address:struct<city:string,zip:array<string>>>"}
  - name: totals
    columns:
      - {name: region, data_type: string, tests: [not_null]}
      - {name: total_quantity, data_type: bigint}
  - name: odd
    columns: [{name: price, data_type: "decimal(10,2)"}]
"""
GATE_DBT = "models: [{name: orders, columns: [{name: id, data_type: bigint, tests: [not_null]}, {name: customer_name, data_type: varchar(100)}]}]"
ERWIN = '<Entities><Entity name="Orders"><Attribute name="id" type="bigint" nullable="false"/><Attribute name="customer_name" type="varchar(100)"/></Entity></Entities>'


def test_declared_schemas():
    s = dbt_schema(DBT, "orders")
    assert s.simpleString() == "struct<id:bigint,region:string,quantity:int,customer:struct<name:string,address:struct<city:string,zip:array<string>>>>"
    assert [f.nullable for f in s] == [False, False, False, True]
    assert erwin_schema(ERWIN, "Orders") == dbt_schema(GATE_DBT, "orders")
    for kind, call in (
        ("ModelNotFound", lambda: dbt_schema(DBT, "none")), ("ParseDbtYaml", lambda: dbt_schema("models: [", "x")), ("ParseDbtYaml", lambda: dbt_schema("models: 3", "x")),
        ("UnsupportedDeclaredType", lambda: dbt_schema(DBT, "odd")), ("EntityNotFound", lambda: erwin_schema(ERWIN, "x")), ("ParseErwinXml", lambda: erwin_schema("<a", "x")),
        ("UnsupportedDeclaredType", lambda: erwin_schema('<E><Entity name="x"><Attribute name="a"/></Entity></E>', "x")), ("InvalidSpec", lambda: parse_spec("dbt:only")),
        ("InvalidSpec", lambda: parse_spec("csv:x")), ("InvalidSpec", lambda: parse_spec("parquet")), ("InvalidDeltaUri", lambda: resolve_schema(parse_spec("delta:/no/scheme"))),
        ("OpenFile", lambda: resolve_schema(parse_spec("dbt:/none.yml:x"))),
    ):
        with pytest.raises(SchemaError) as e:
            call()
        assert e.value.kind == kind
    assert dbt_schema(DBT, "odd", extended=True)["price"].dataType == T.DecimalType(10, 2)
    assert parse_spec("dbt:/a:b.yml:m").path == "/a:b.yml"


def test_grammar():
    assert [parse_literal(t) for t in ("5", "-3", "1e3", "true", "True", "x", "9223372036854775808", "1_000")] == [5, -3, 1000.0, True, "True", "x", 9.223372036854775808e18, "1_000"]
    assert parse_literal("inf") == float("inf") and parse_literal("NaN") != parse_literal("NaN")
    assert parse_op("filter:name,eq,a,b").value == "a,b"
    assert parse_op("aggregate:group=;sum(q)=t").group_by == ()
    assert parse_op("sort:a,asc;b,desc") == Sort((("a", True), ("b", False)))
    for bad in ("select", "filter:a,xx,1", "filter:a,eq", "aggregate:sum(q)=t", "aggregate:group=a;median(q)=t", "aggregate:group=a;sum(q)", "sort:a", "sort:a,up", "limit:x", "limit:-1", "drop:x"):
        with pytest.raises(SchemaError):
            parse_op(bad)


def test_operations(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 3), (None, 5)], "region string, q int")
    run = lambda *ops: [tuple(r) for r in apply_ops(df, [parse_op(o) for o in ops]).collect()]
    assert run("filter:q,gt,0", "aggregate:group=region;sum(q)=total,count(q)=n", "sort:total,desc") == [(None, 5, 1), ("a", 4, 2)]
    assert run("sort:q,asc", "select:q") == [(1,), (3,), (5,), (None,)] and run("sort:q,desc", "select:q", "limit:1") == [(5,)]
    assert run("aggregate:group=;min(q)=a,max(q)=b,avg(q)=c,count(q)=d") == [(1, 5, 3.0, 3)]
    assert [len(run(f"filter:q,{c},3")) for c in ("eq", "ne", "gt", "lt", "ge", "le")] == [1, 2, 1, 1, 2, 2]


def test_struct_source():
    s = dbt_schema(DBT, "orders")
    text = struct_source(s, "Order")
    assert text.index("class OrderCustomerAddress") < text.index("class OrderCustomer:") < text.index("class Order:")
    made = contract_class(s, "Order")
    assert struct_type(made).simpleString() == s.simpleString() and [f.nullable for f in struct_type(made)] == [f.nullable for f in s]
    for schema, name in ((T.StructType([T.StructField("a b", T.LongType())]), "X"), (T.StructType([T.StructField("class", T.LongType())]), "X"), (s, "1x")):
        with pytest.raises(SchemaError):
            struct_source(schema, name)
    with pytest.raises(SchemaError):
        struct_source(T.StructType([T.StructField("d", T.DateType())]), "X")


@pytest.fixture
def declared(spark, tmp_path):
    (tmp_path / "dbt.yml").write_text("models: [{name: orders, columns: [{name: region, data_type: string, tests: [not_null]}, {name: quantity, data_type: int, tests: [not_null]}]}, {name: totals, columns: [{name: region, data_type: string, tests: [not_null]}, {name: total_quantity, data_type: bigint}]}]")
    df = spark.createDataFrame([("n", 5), ("s", -1), ("n", 10)], "region string, quantity int").repartition(3)
    df.write.parquet(str(tmp_path / "data.parquet"))
    return tmp_path


OPS = ("filter:quantity,gt,0", "aggregate:group=region;sum(quantity)=total_quantity")


def spec_of(d, **kw):
    return PipelineSpec(f"dbt:{d}/dbt.yml:orders", "Order", f"{d}/out", f"{d}/data.parquet", target_schema=f"dbt:{d}/dbt.yml:totals", **kw)


@pytest.mark.parametrize("kw", [{"transform_df": OPS}, {"transform_sql": "SELECT region, sum(quantity) AS total_quantity FROM batch WHERE quantity > 0 GROUP BY region"}])
def test_run_and_generated_program_agree(spark, declared, kw):
    spec = spec_of(declared, **kw)
    assert spec.run(spark).rows_processed == 1
    want = spark.read.parquet(spec.sink_parquet).collect()
    assert [tuple(r) for r in want] == [("n", 15)]
    scope = {"__name__": "generated"}
    exec(compile(pipeline_source(spec), "generated", "exec"), scope)
    scope["main"]()
    assert spark.read.parquet(spec.sink_parquet).collect() == want


def test_passthrough_and_errors(spark, declared):
    assert PipelineSpec(f"parquet:{declared}/data.parquet", "Order", f"{declared}/copy").run(spark).rows_processed == 3
    for kind, spec in (
        ("ConflictingTransform", spec_of(declared, transform_sql="SELECT 1", transform_df=OPS)),
        ("MissingSourceData", PipelineSpec(f"dbt:{declared}/dbt.yml:orders", "Order", "x")),
        ("UnknownFormat", PipelineSpec(f"dbt:{declared}/dbt.yml:orders", "Order", "x", "/data/unknown")),
    ):
        with pytest.raises(SchemaError) as e:
            pipeline_source(spec)
        assert e.value.kind == kind
    with pytest.raises(ContractMismatch):
        spec_of(declared).run(spark)


def test_command_line(spark, declared, capsys, tmp_path):
    spark.createDataFrame([(1, "a")], "id bigint, name string").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert cli.main(["struct", str(tmp_path / "p"), "--name", "Order"]) == 0 and "class Order:" in capsys.readouterr().out
    out = str(tmp_path / "made.py")
    args = ["pipeline", "--source-schema", f"dbt:{declared}/dbt.yml:orders", "--source-data", f"{declared}/data.parquet", "--sink-parquet", f"{declared}/o", "--name", "Order", "--transform-df", OPS[0], "--out", out]
    assert cli.main(args) == 0 and "def main" in open(out).read()
    assert cli.main([*args, "--transform-sql", "SELECT 1"]) == 1 and "ConflictingTransform" in capsys.readouterr().err
    (tmp_path / "x.csv").write_text('a,b\n1,"x,y"\n')
    assert cli.main(["csv-select", str(tmp_path / "x.csv"), "--column", "1"]) == 0 and capsys.readouterr().out == 'b\n"x,y"\n'
    assert cli.main(["csv-select", str(tmp_path / "x.csv"), "--column", "9"]) == 1 and capsys.readouterr().out == ""
    done = subprocess.run([sys.executable, "-m", "tessel.codegen.cli", "nothing"], capture_output=True, cwd=sys.path[0])
    assert done.returncode != 0


def test_gate(spark, tmp_path):
    @contract
    class Model:
        id: int
        customer_name: "str | None"

    (tmp_path / "d.yml").write_text(GATE_DBT)
    (tmp_path / "e.xml").write_text(ERWIN)
    struct = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("customer_name", T.StringType())])
    overwrite_delta(spark.createDataFrame([], struct), f"file://{tmp_path}/delta")
    sources = [f"dbt:{tmp_path}/d.yml:orders", f"erwin:{tmp_path}/e.xml:Orders", f"delta:file://{tmp_path}/delta"]
    check_gate(Model, sources)
    check_gate(shape_of(Model), sources[:2])
    assert cli.main(["gate", *sources]) == 0

    @contract
    class Swapped:
        customer_name: "str | None"
        id: int

    with pytest.raises(ContractMismatch):
        check_gate(Swapped, sources)

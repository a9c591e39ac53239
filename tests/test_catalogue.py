import math
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessel.operators import JoinPlan, asof_join, global_rank, joined, percent_of_total, range_join, row_cap, running_total
from tessel.operators.catalogue import CATALOGUE
from tessel.sources import orders_csv, shipments_csv

# Ids, amounts and times that the expected results of the published queries rest on; notes and carriers are our own.
ORDERS = """id,amount,placed_at,note
1,100.00,2026-01-05T10:00:00,bring to the front desk
2,250.75,2026-01-03T08:15:00,
3,99.99,2026-01-07T23:59:59,quick please
4,1000.00,2026-01-01T00:00:00,""
5,45.50,2026-01-04T12:30:00,one of two alike
6,45.50,2026-01-04T12:30:00,a second of one price
7,0.01,2026-01-02T06:45:00,tiny
8,999999.99,2026-01-06T18:20:00,largest there is
"""
SHIPMENTS = """order_id,carrier,shipped_at
1,north,2026-01-06T09:00:00
2,river,2026-01-04T10:00:00
3,north,2026-01-08T09:00:00
3,coast,2026-01-08T11:00:00
4,river,2026-01-02T09:00:00
8,north,2026-01-07T09:00:00
"""


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    (d / "orders.csv").write_text(ORDERS)
    (d / "shipments.csv").write_text(SHIPMENTS)
    extra = {"load_no": F.lit(1), "loaded_at": F.col("placed_at"), "deleted_at": F.lit(None).cast("timestamp_ntz")}
    orders_csv(spark, str(d / "orders.csv")).withColumns(extra).write.parquet(str(d / "shop_orders.parquet"))
    shipments_csv(spark, str(d / "shipments.csv")).withColumn("shipment_id", F.monotonically_increasing_id()).write.parquet(str(d / "shipments.parquet"))
    return str(d)


def run(name, spark, d):
    return CATALOGUE[name].frame(spark, d).collect()


def test_row_query_in_order(spark, small):
    assert [r.id for r in run("row_filter_project_sort", spark, small)] == [4, 2, 1, 8, 3]


def test_aggregates(spark, small):
    assert tuple(run("agg_count_sum_filtered", spark, small)[0]) == (5, Decimal("1001450.73"))
    assert tuple(run("multi_predicate", spark, small)[0]) == (3, Decimal("1000199.98"))
    assert len(run("group_by_nullable_note", spark, small)) == 7
    assert run("amount_range", spark, small)[0][0] == Decimal("999999.98")
    assert CATALOGUE["amount_range"].frame(spark, small).schema[0].dataType.simpleString() == "decimal(11,2)"


@pytest.mark.parametrize("name", ["inner_join_agg", "merge_join_agg", "shuffle_hash_join_agg", "broadcast_join_agg"])
def test_join_aggregate(spark, small, name):
    assert tuple(run(name, spark, small)[0]) == (6, Decimal("1001550.72"))


def test_left_join(spark, small):
    rows = [(r.id, r.carrier) for r in run("left_join_shipments", spark, small)]
    assert rows == [(1, "north"), (2, "river"), (3, "coast"), (3, "north"), (4, "river"), (5, None), (6, None), (7, None), (8, "north")]


def test_rank_and_parity(spark, small):
    assert {r.id: r.amount_rank for r in run("rank_by_amount", spark, small)} == {8: 1, 4: 2, 2: 3, 1: 4, 3: 5, 5: 6, 6: 6, 7: 8}
    rows = [(r.id, str(r.running_total), r.placed_day, r.amount_rank) for r in run("parity_query", spark, small)]
    assert rows == [
        (2, "1250.76", 3, 3), (4, "1000.00", 1, 2), (6, "1341.76", 4, 6), (1, "1441.76", 5, 4), (8, "1001441.75", 6, 1), (5, "1296.26", 4, 6), (3, "1001541.74", 7, 5), (7, "1000.01", 2, 8),
    ]


def test_shares_multipliers_and_sets(spark, small):
    rows = percent_of_total(spark.read.parquet(f"{small}/shop_orders.parquet"), "amount").collect()
    assert abs(sum(r.percent_of_total for r in rows) - 100) < 1e-9
    assert abs(next(r.percent_of_total for r in rows if r.id == 1) - 10000 / 100154174 * 100) < 1e-12
    assert [r.multiplier for r in sorted(run("region_multiplier", spark, small))] == [1.5, 1.0, 1.0, 1.5, 0.8, 0.8, 1.0, 1.5]
    assert sorted(r.id for r in run("except_ids", spark, small)) == [1, 2, 3, 5, 6]
    for name in ("cte_high_value", "derived_table", "pipe_syntax"):
        assert sorted(r.id for r in run(name, spark, small)) == [2, 4, 8]


@pytest.mark.parametrize(
    ("most", "limit", "offset", "want"), [(5, 2, 2, [3, 4]), (5, 99, 2, [3, 4, 5, 6, 7]), (5, None, 2, [3, 4, 5, 6, 7]), (0, 2, 0, []), (0, None, 3, []), ((1 << 63) - 1, 2, 0, [1, 2])]
)
def test_row_cap(spark, most, limit, offset, want):
    df = spark.range(1, 9).orderBy("id").offset(offset)
    df = df if limit is None else df.limit(limit)
    assert [r.id for r in row_cap(df, most).collect()] == want
    assert [r.id for r in row_cap(row_cap(df, most), most).collect()] == want


def test_row_cap_refuses_negatives(spark):
    with pytest.raises(ValueError):
        row_cap(spark.range(3), -1)


WITH_TEXT = [n for n, q in CATALOGUE.items() if q.sql]


@pytest.mark.parametrize("name", WITH_TEXT)
def test_sql_and_frame_agree(spark, sf, name):
    a, b = CATALOGUE[name].frame(spark, sf), CATALOGUE[name].by_sql(spark, sf)
    assert sorted(a.columns) == sorted(b.columns)
    # a mean or share may differ in its last digit
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(map(near, r)) for r in a.collect()) == Counter(tuple(map(near, r)) for r in b.select(*a.columns).collect())


@pytest.mark.parametrize("name", ["agg_fn_set", "parity_query", "inner_join_agg", "percent_of_total_partitioned"])
def test_partitions_do_not_matter(spark, sf, name, tmp_path):
    want = Counter(map(str, run(name, spark, sf)))
    for n in (1, 7):
        d = tmp_path / str(n)
        for t in ("shop_orders", "shipments"):
            spark.read.parquet(f"{sf}/{t}.parquet").repartition(n).write.parquet(f"{d}/{t}.parquet")
        assert Counter(map(str, run(name, spark, str(d)))) == want


NULLS = "id int, amount decimal(10,2), at timestamp_ntz, g string"


def test_ordered_operators_with_nulls_ties_and_small_ranges(spark, monkeypatch):
    from tessel import scale
    from tessel.operators import ordered

    rows = [(k, None if k % 5 == 0 else Decimal(k % 7), None, "a" if k % 3 else None) for k in range(60)] * 2
    df = spark.createDataFrame(rows, NULLS).withColumn("at", F.expr("case when id % 11 <> 0 then timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,id % 4) end"))
    monkeypatch.setattr(ordered, "in_ranges", lambda d, o, *_: scale.in_ranges(d, o, 5))
    df.createOrReplaceTempView("t_nulls")
    order = "at nulls last, id nulls last, amount nulls last, g nulls last"
    want = spark.sql(f"select id, rank() over (order by amount desc nulls last) r, sum(amount) over (order by {order} rows unbounded preceding) s from t_nulls")
    got = running_total(global_rank(df, "amount", "r"), "at", ["id", "amount", "g"], "amount", "s").select("id", "r", "s")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    shares = percent_of_total(df, "amount", ["g"])
    want = spark.sql("select id, cast(amount as double) / cast(sum(amount) over (partition by g) as double) * 100 p from t_nulls")
    assert Counter((r.id, r.percent_of_total and round(r.percent_of_total, 9)) for r in shares.collect()) == Counter((r.id, r.p and round(r.p, 9)) for r in want.collect())


def test_rank_and_share_compare_values(spark):
    df = spark.createDataFrame([(0.0, "\\N"), (-0.0, None), (1.0, "\\N"), (float("nan"), None), (None, "")], "x double, g string")
    got = Counter((str(r.x), r.r) for r in global_rank(df, "x", "r").collect())
    assert got == {("nan", 1): 1, ("1.0", 2): 1, ("0.0", 3): 1, ("-0.0", 3): 1, ("None", 5): 1}
    pairs = spark.createDataFrame([(3.0, None), (7.0, "\\N")], "x double, g string")
    assert sorted(r.percent_of_total for r in percent_of_total(pairs, "x", ["g"]).collect()) == [100.0, 100.0]


def test_share_of_a_zero_total(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "x double")
    out = {r.x: r.percent_of_total for r in percent_of_total(df, "x").collect()}
    assert out[1.0] == math.inf and out[-1.0] == -math.inf and math.isnan(out[0.0]) and out[None] is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], NULLS)
    assert global_rank(df, "amount").collect() == running_total(df, "at", ["id"], "amount").collect() == percent_of_total(df, "amount").collect() == []


@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_asof_join(spark, rows_per_range):
    left = [(k, k % 3 if k % 10 else None, None if k % 17 == 0 else k * 5 % 50) for k in range(60)]
    right = [(k % 4 if k % 9 else None, None if k % 13 == 0 else k * 7 % 60, f"v{k:02d}") for k in range(50)]
    a, b = spark.createDataFrame(left, "id int, k int, at int"), spark.createDataFrame(right, "k int, at int, v string")
    got = {r.id: r.v for r in asof_join(a, b, "k", "at", "at", ["v"], rows_per_range).collect()}
    want = {i: max(((t, v) for g, t, v in right if g is not None and t is not None and g == k and t <= at), default=(0, None))[1] if k is not None and at is not None else None for i, k, at in left}
    assert got == want
    assert asof_join(a, b.limit(0), "k", "at", "at", ["v"]).where("v is not null").count() == 0


def test_range_join(spark):
    points = spark.createDataFrame([(k, k * 3) for k in range(40)] + [(99, None)], "p int, at int")
    spans = spark.createDataFrame([(k, k * 5, k * 5 + k) for k in range(20)] + [(50, 3, None)], "s int, a int, b int")
    got = {(r.p, r.s) for r in range_join(points, spans, "at", "a", "b", 10).collect()}
    assert got == {(p, s) for p in range(40) for s in range(20) if s * 5 <= p * 3 < s * 5 + s}


def test_broadcast_only_within_its_bound(spark):
    from tessel.plans import executed_operators

    a, b = spark.range(2000), spark.range(500)
    for most, node in ((100_000, "BroadcastHashJoin"), (1000, "SortMergeJoin")):
        df = joined(a, b, ["id"], plan=JoinPlan.BROADCAST, most_bytes=most)
        df.collect()
        assert node in executed_operators(df)

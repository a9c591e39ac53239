from decimal import Decimal

from pyspark.sql import functions as F

from tessel import datasets
from tessel.functions import add_one_deep, checksum_deep


def test_orders_and_shipments(spark):
    o = datasets.orders_cycle(spark, 20_000)
    row = o.where("amount > 50").agg(F.count("*"), F.sum("amount")).first()
    assert (row[0], row[1]) == datasets.orders_cycle_sums(20_000)
    assert o.where("note is null").count() == 4_000
    s = datasets.shipments_even(spark, 20_000)
    assert s.count() == 10_001 and s.where("order_id = 0").count() == 2 and s.where("order_id % 2 = 1").count() == 0
    joined = o.join(s, o.id == s.order_id).where("amount > 50")
    assert joined.count() == 5_000


def test_hash_orders(spark):
    rows = datasets.orders_hash(spark, 500).collect()
    for r in rows:
        assert r.amount == Decimal((((r.id * 2654435761) % 2**64) >> 16) % 9901 + 100) / 100 and (r.note is None) == (r.id % 7 == 0)
    m = datasets.shipments_mod3(spark, 300)
    assert m.count() == 300 and {r.carrier for r in m.where("order_id = 8").collect()} == {"carrier-3", "carrier-4"}


def test_samples(spark):
    assert datasets.pruning_sample(spark).where("amount >= 4000").count() == 91
    sample = datasets.spill_sample(spark, 1000)
    assert [r.id for r in sample.orderBy("placed_at").limit(2).collect()] == [999, 998] and sample.where("length(note) <> 135").count() == 0
    assert datasets.flat_columns(spark, 10, 3).agg(F.sum("c2")).first()[0] == 65.0
    assert [r.xs for r in datasets.nested_lists(spark, 3, 2).collect()] == [[0.0], [1.0, 2.0], [2.0]]
    deep = datasets.five_levels(spark, 20, 2, 2, 3)
    want = n = 0
    for r in range(20):
        for w in range(r % 2 + 1):
            for t in range((r + w) % 2 + 1):
                for i in range((r + w + t) % 3 + 1):
                    want, n = want + r + w + t + i, n + 1
    sums = deep.agg(F.sum(checksum_deep("wrappers")), F.sum(checksum_deep(add_one_deep("wrappers")))).first()
    assert (sums[0], sums[1]) == (want, want + n)

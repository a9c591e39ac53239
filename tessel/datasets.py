"""Deterministic synthetic data, made on the executors from row numbers, and the sums they must give."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Notes that orders cycle through, the fifth being none, and carriers of shipments.
NOTES = ("front desk", "blue crate", "call before", "two boxes", None)
CARRIERS = ("north", "river", "coast", "hill")


def _ntz(micros) -> F.Column:
    return F.timestamp_micros(micros.cast("bigint")).cast("timestamp_ntz")


def orders_cycle(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """Amounts cycle from 1 to 100, times are spread evenly over a day, every fifth note is null."""
    i = F.col("id")
    note = F.element_at(F.array(*(F.lit(x) for x in NOTES)), (i % len(NOTES) + 1).cast("int"))
    return spark.range(0, n, 1, parts).select(i, ((i % 100) + 1).cast("decimal(10,2)").alias("amount"), _ntz((i * DAY / n).cast("bigint")).alias("placed_at"), note.alias("note"))


def orders_cycle_sums(n: int) -> tuple[int, Decimal]:
    """Count and sum of amounts over 50, for ``n`` divisible by 100."""
    return n // 2, Decimal(n) * Decimal("37.75")


def shipments_even(spark: SparkSession, n_orders: int, parts: int | None = None) -> DataFrame:
    """One shipment for each even order, and a second one for order 0."""
    half = (n_orders + 1) // 2
    position = F.col("id")
    order = F.when(position == half, 0).otherwise(position * 2)
    carrier = F.element_at(F.array(*map(F.lit, CARRIERS)), (position % len(CARRIERS) + 1).cast("int"))
    return spark.range(0, half + 1, 1, parts).select(order.cast("bigint").alias("order_id"), carrier.alias("carrier"), _ntz((order * DAY / n_orders).cast("bigint")).alias("shipped_at"))


def orders_hash(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """Amounts from a multiplicative hash, null notes for every seventh order."""
    i = F.col("id")
    product = (i.cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(38,0)")) % F.lit(str(1 << 64)).cast("decimal(38,0)")
    cents = F.floor(product / 65536).cast("decimal(38,0)") % 9901 + 100
    amount = (cents.cast("bigint") / F.lit(100)).cast("decimal(10,2)")
    note = F.when(i % 7 != 0, F.concat(F.lit("note-"), i.cast("string")))
    return spark.range(0, n, 1, parts).select(i, amount.alias("amount"), _ntz((i * DAY / n).cast("bigint")).alias("placed_at"), note.alias("note"))


def shipments_mod3(spark: SparkSession, n_orders: int, parts: int | None = None) -> DataFrame:
    """``id % 3`` shipments for each order."""
    i = F.col("order_id")
    rows = spark.range(0, n_orders, 1, parts).withColumnRenamed("id", "order_id").where("order_id % 3 > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (i % 3 - 1).cast("int"))))
    carrier = F.concat(F.lit("carrier-"), ((i + F.col("k")) % 5).cast("string"))
    return rows.select("order_id", carrier.alias("carrier"), _ntz(i * DAY / 1_000_000_000 + (F.col("k") + 1) * DAY).alias("shipped_at"))


def pruning_sample(spark: SparkSession, n: int = 4096) -> DataFrame:
    i = F.col("id")
    return spark.range(0, n, 1, 1).select(i, F.when(i % 17 != 0, i).cast("decimal(10,2)").alias("amount"), F.when(i % 3 != 0, F.concat(F.lit("note-"), i.cast("string"))).alias("note"))


def spill_sample(spark: SparkSession, n: int = 65_536) -> DataFrame:
    """Rows whose order by time is the reverse of their ids, with wide notes."""
    i = F.col("id")
    note = F.concat(F.lpad(i.cast("string"), 6, "0"), F.lit("-" + "n" * 128))
    return spark.range(n).select(i, F.lit(Decimal("60.00")).cast("decimal(10,2)").alias("amount"), _ntz(F.lit(n) - i).alias("placed_at"), note.alias("note"))


def flat_columns(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return spark.range(rows).select(*((F.col("id") + c).cast("double").alias(f"c{c}") for c in range(columns)))


def nested_lists(spark: SparkSession, rows: int, most: int) -> DataFrame:
    """Lists of length ``r % most + 1`` with items from ``r`` on."""
    r = F.col("id")
    return spark.range(rows).select(r.alias("r"), F.transform(F.sequence(F.lit(0), (r % most).cast("int")), lambda i: (r + i).cast("double")).alias("xs"))


def five_levels(spark: SparkSession, rows: int, wrappers: int, items: int, values: int) -> DataFrame:
    """Arrays of structs of arrays of structs of arrays."""
    r = F.col("id")
    upto = lambda n: F.sequence(F.lit(0), n.cast("int"))
    numbers = lambda w, t: F.transform(upto((r + w + t) % values), lambda i: (r + w + t + i).cast("double"))
    inner = lambda w: F.transform(upto((r + w) % items), lambda t: F.struct(numbers(w, t).alias("values")))
    return spark.range(rows).select(r.alias("r"), F.transform(upto(r % wrappers), lambda w: F.struct(inner(w).alias("items"))).alias("wrappers"))

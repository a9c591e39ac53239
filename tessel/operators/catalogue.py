"""The catalogue of relational queries over orders and shipments, each as SQL text and as a DataFrame.

``orders`` are the rows of shop_orders.  The texts are standard SQL: they run on Spark as on any engine, and a test holds
both forms of each query against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..tables import table, views
from .guardrail import row_cap
from .joins import JoinPlan, joined
from .ordered import global_rank, percent_of_total, running_total

THRESHOLD = Decimal("50.00")


@dataclass(frozen=True)
class Query:
    """``frame`` builds the DataFrame form; ``sql`` is the text for Spark; ``other`` is the text for other engines if it must differ."""

    frame: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    other: str | None = None

    def by_sql(self, spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, "shop_orders", "shipments", "embeddings", "documents", "manifests_v2")
        return spark.sql(self.sql)


def _orders(spark, d):
    return table(spark, d, "shop_orders")


def _shipments(spark, d):
    return table(spark, d, "shipments")


def _count_sum(df: DataFrame, amount="amount") -> DataFrame:
    return df.agg(F.count("*").alias("order_count"), F.sum(amount).cast("decimal(20,2)").alias("total_amount"))


_COUNT_SUM = "count(*) AS order_count, CAST(sum(amount) AS DECIMAL(20,2)) AS total_amount"


def _above(df: DataFrame, least=THRESHOLD) -> DataFrame:
    return df.where(F.col("amount") > F.lit(least))


def _bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.col("id") % 1000)


def _join(spark, d, plan: JoinPlan) -> DataFrame:
    o, s = _orders(spark, d).select("id", "amount"), _shipments(spark, d).select("order_id")
    return _count_sum(_above(joined(s, o, F.col("id") == F.col("order_id"), plan=plan)))


_JOIN_SQL = f"SELECT {_COUNT_SUM} FROM shop_orders JOIN shipments ON id = order_id WHERE amount > 50.00"


def _left_join(spark, d):
    o, s = _orders(spark, d).select("id", "load_no", "amount"), _shipments(spark, d).select("order_id", "carrier", "shipment_id")
    return o.join(s, F.col("id") == F.col("order_id"), "left").select("id", "load_no", "amount", "carrier", "shipment_id").orderBy(F.asc_nulls_last("id"), F.asc_nulls_last("carrier"))


def _comparators(spark, d):
    o = _orders(spark, d)
    tests = {"eq": F.col("id") == 345, "ne": F.col("id") != 345, "gt": F.col("id") > 345, "lt": F.col("id") < 345, "ge": F.col("id") >= 345, "le": F.col("id") <= 345}
    out = [F.struct(F.lit(k).alias("comparator"), F.coalesce(F.count_if(t), F.lit(0)).alias("n_rows")) for k, t in tests.items()]
    return o.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


_COMPARATORS = " UNION ALL ".join(
    f"SELECT '{k}' AS comparator, count(*) AS n_rows FROM shop_orders WHERE id {op} 345" for k, op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="))
)


# the mean is divided as double on both sides: decimal means differ in scale between engines
_AGGS = "CAST(sum(amount) AS DECIMAL(20,2)) AS total, count(amount) AS n, round(CAST(sum(amount) AS DOUBLE) / count(amount), 6) AS mean, min(amount) AS least, max(amount) AS greatest"


def _agg_fn_set(spark, d, *by):
    mean = F.when(F.count("amount") > 0, F.round(F.sum("amount").cast("double") / F.count("amount"), 6))
    return _orders(spark, d).groupBy(*by).agg(
        F.sum("amount").cast("decimal(20,2)").alias("total"), F.count("amount").alias("n"), mean.alias("mean"), F.min("amount").alias("least"), F.max("amount").alias("greatest")
    )


def _rank(spark, d):
    return global_rank(_orders(spark, d).select("id", "load_no", "amount"), "amount", "amount_rank")


def _running(spark, d):
    return running_total(_orders(spark, d).select("id", "load_no", "placed_at", "amount", "note"), "placed_at", ["id", "load_no", "amount", "note"], "amount").select(
        "id", "load_no", F.extract(F.lit("DAY"), "placed_at").cast("int").alias("placed_day"), F.col("running_total").cast("decimal(20,2)").alias("running_total")
    )


_RUN = "CAST(sum(amount) OVER (ORDER BY placed_at NULLS LAST, id NULLS LAST, load_no NULLS LAST, amount NULLS LAST, note NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(20,2)) AS running_total"


def _parity(spark, d):
    o = _orders(spark, d).select("id", "load_no", "amount", "note", "placed_at")
    o = global_rank(running_total(o, "placed_at", ["id", "load_no", "amount", "note"], "amount"), "amount", "amount_rank")
    return o.select(
        "id", "amount", "note", F.extract(F.lit("DAY"), "placed_at").cast("int").alias("placed_day"), F.col("running_total").cast("decimal(20,2)").alias("running_total"), "amount_rank"
    ).orderBy(F.asc_nulls_first("note"), F.asc_nulls_last("id"))


def _percent(spark, d, by=None):
    o = percent_of_total(_orders(spark, d).select("id", "load_no", "amount"), "amount", by)
    return o.select("id", "load_no", F.round("percent_of_total", 9).alias("percent_of_total"))


def _guarded_cast(spark, d):
    return _orders(spark, d).select("id", "load_no", F.when(F.col("note").rlike(r"^[0-9]{1,9}\z"), F.col("note").cast("bigint")).otherwise(F.length("note").cast("bigint")).alias("value"))


_DAYS = "CAST(date_diff('day', DATE '1970-01-01', CAST(placed_at AS DATE)) AS BIGINT)"


def _digest(spark, d):
    return _orders(spark, d).agg(F.count("*").alias("row_count"), X.multiset_digest("id", "load_no", "note").alias("content_digest"))


def _cell(c: str) -> str:
    return f"coalesce('v' || CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'n')"


_DIGEST = (
    "SELECT count(*) AS row_count, lpad(lower(hex(CAST(sum(CAST(('0x' || substr(md5("
    + " || ".join(map(_cell, ("id", "load_no", "note")))
    + "), 1, 16)) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS UBIGINT))), 16, '0') AS content_digest FROM shop_orders"
)


def _ingest_violations(spark, d):
    from ..contracts import Validator
    from ..contracts.validate import INGEST

    return Validator(INGEST).violations(table(spark, d, "headers").select("id", "name", "note"))


def _embedding(spark, d):
    return table(spark, d, "embeddings")


def _deep(spark, d):
    """Five levels made of each embedding: wrappers of items of values."""
    xs = F.col("embedding").cast("array<double>")
    item = lambda a: F.struct(a.alias("values"))
    wrappers = F.array(F.struct(F.array(item(F.slice(xs, 1, 4)), item(F.slice(xs, 5, 4))).alias("items")), F.struct(F.array(item(xs)).alias("items")))
    return _embedding(spark, d).select("vec_id", F.round(X.checksum_deep(X.add_one_deep(wrappers)), 4).alias("checksum"))


def _dictionary(spark, d):
    s = _shipments(spark, d)
    words = s.select("carrier").where(F.col("carrier").isNotNull()).distinct().withColumn("code", F.xxhash64("carrier"))
    coded = s.select("shipment_id", F.when(F.col("carrier").isNotNull(), F.xxhash64("carrier")).alias("code"))
    return X.decode_dictionary(coded, words, "code").groupBy("carrier").agg(F.count("*").alias("n_rows"))


def _runs(spark, d):
    runs = _orders(spark, d).groupBy("load_no").agg(F.count("*").alias("n")).select(F.col("load_no"), F.lit(0).cast("bigint").alias("start"), F.col("n").alias("length"))
    return X.decode_runs(runs).groupBy("load_no").agg(F.count("*").alias("n"), F.max("position").alias("last_position"))


_ROW = "SELECT id, amount, placed_at, note FROM shop_orders WHERE amount > 50.00"
_TOTAL_ORDER = ["id", "load_no", "amount", "placed_at", "note"]


def _sorted(spark, d):
    return _orders(spark, d).select(*_TOTAL_ORDER).orderBy(*(F.asc_nulls_last(c) for c in _TOTAL_ORDER))


_SORTED = "SELECT id, load_no FROM shop_orders ORDER BY " + ", ".join(f"{c} NULLS LAST" for c in _TOTAL_ORDER)

CATALOGUE: dict[str, Query] = {
    "row_filter_project_sort": Query(lambda s, d: _above(_orders(s, d)).select("id", "amount", "placed_at", "note").orderBy(F.asc_nulls_last("placed_at")), f"{_ROW} ORDER BY placed_at NULLS LAST"),
    "select_star": Query(lambda s, d: _orders(s, d).select("*"), "SELECT * FROM shop_orders"),
    "computed_column": Query(lambda s, d: _bucket(_orders(s, d)).select("id", "load_no", "bucket"), "SELECT id, load_no, id % 1000 AS bucket FROM shop_orders"),
    "filter_not_projected": Query(lambda s, d: _above(_orders(s, d)).select("id"), "SELECT id FROM shop_orders WHERE amount > 50.00"),
    "constant_false": Query(lambda s, d: _orders(s, d).where(F.lit(False)).select("id", "amount"), "SELECT id, amount FROM shop_orders WHERE false"),
    "equality_and_at_least": Query(lambda s, d: _orders(s, d).where((F.col("id") == 345) | (F.col("amount") >= Decimal("4000.00"))).select("id", "amount"), "SELECT id, amount FROM shop_orders WHERE id = 345 OR amount >= 4000.00"),
    "agg_count_sum_filtered": Query(lambda s, d: _count_sum(_above(_orders(s, d))), f"SELECT {_COUNT_SUM} FROM shop_orders WHERE amount > 50.00"),
    "agg_conditional_sums": Query(
        lambda s, d: _orders(s, d).agg(F.sum(F.when(F.col("amount") > THRESHOLD, F.col("amount"))).cast("decimal(20,2)").alias("over"), F.sum(F.when(F.col("amount") <= THRESHOLD, F.col("amount"))).cast("decimal(20,2)").alias("under")),
        "SELECT CAST(sum(amount) FILTER (WHERE amount > 50.00) AS DECIMAL(20,2)) AS over, CAST(sum(CASE WHEN amount <= 50.00 THEN amount END) AS DECIMAL(20,2)) AS under FROM shop_orders",
    ),
    "group_by_bucket": Query(
        lambda s, d: _bucket(_orders(s, d)).groupBy("bucket").agg(F.count("*").alias("order_count"), F.sum("amount").cast("decimal(20,2)").alias("total_amount")).orderBy("bucket"),
        f"SELECT id % 1000 AS bucket, {_COUNT_SUM} FROM shop_orders GROUP BY id % 1000 ORDER BY bucket",
    ),
    "multi_predicate": Query(lambda s, d: _count_sum(_above(_orders(s, d)).where(F.col("note").isNotNull())), f"SELECT {_COUNT_SUM} FROM shop_orders WHERE amount > 50.00 AND note IS NOT NULL"),
    "group_by_nullable_note": Query(lambda s, d: _orders(s, d).groupBy("note").agg(F.count("*").alias("n_rows")), "SELECT note, count(*) AS n_rows FROM shop_orders GROUP BY note"),
    "agg_fn_set": Query(lambda s, d: _agg_fn_set(s, d, "load_no"), f"SELECT load_no, {_AGGS} FROM shop_orders GROUP BY load_no"),
    "agg_fn_set_whole": Query(lambda s, d: _agg_fn_set(s, d), f"SELECT {_AGGS} FROM shop_orders"),
    "count_rows": Query(lambda s, d: _orders(s, d).agg(F.count("*").alias("n_rows")), "SELECT count(*) AS n_rows FROM shop_orders"),
    "left_join_shipments": Query(_left_join, "SELECT id, load_no, amount, carrier, shipment_id FROM shop_orders LEFT JOIN shipments ON id = order_id ORDER BY id NULLS LAST, carrier NULLS LAST"),
    "inner_join_agg": Query(lambda s, d: _join(s, d, JoinPlan.AUTO), _JOIN_SQL),
    "merge_join_agg": Query(lambda s, d: _join(s, d, JoinPlan.SORT_MERGE), _JOIN_SQL),
    "shuffle_hash_join_agg": Query(lambda s, d: _join(s, d, JoinPlan.SHUFFLE_HASH), _JOIN_SQL),
    "broadcast_join_agg": Query(lambda s, d: _join(s, d, JoinPlan.BROADCAST), _JOIN_SQL),
    "rank_by_amount": Query(_rank, "SELECT id, load_no, amount, CAST(rank() OVER (ORDER BY amount DESC NULLS LAST) AS BIGINT) AS amount_rank FROM shop_orders"),
    "running_total": Query(_running, f"SELECT id, load_no, CAST(EXTRACT(DAY FROM placed_at) AS INT) AS placed_day, {_RUN} FROM shop_orders"),
    "parity_query": Query(
        _parity,
        f"SELECT id, amount, note, CAST(EXTRACT(DAY FROM placed_at) AS INT) AS placed_day, {_RUN}, CAST(rank() OVER (ORDER BY amount DESC NULLS LAST) AS BIGINT) AS amount_rank FROM shop_orders ORDER BY note NULLS FIRST, id NULLS LAST",
    ),
    "percent_of_total": Query(_percent, "SELECT id, load_no, round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE) * 100, 9) AS percent_of_total FROM shop_orders"),
    "percent_of_total_partitioned": Query(
        lambda s, d: _percent(s, d, ["load_no"]),
        "SELECT id, load_no, round(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY load_no) AS DOUBLE) * 100, 9) AS percent_of_total FROM shop_orders",
    ),
    "except_ids": Query(
        lambda s, d: _above(_orders(s, d), Decimal("40")).select("id").subtract(_above(_orders(s, d), Decimal("500")).select("id")),
        "SELECT id FROM shop_orders WHERE amount > 40 EXCEPT SELECT id FROM shop_orders WHERE amount > 500",
    ),
    "cte_high_value": Query(
        lambda s, d: _above(_orders(s, d), Decimal("100")).select("id", "amount"),
        "WITH high_value AS (SELECT id, amount FROM shop_orders WHERE amount > 100) SELECT id, amount FROM high_value",
    ),
    "derived_table": Query(lambda s, d: _above(_orders(s, d), Decimal("100")).select("id", "amount"), "SELECT id, amount FROM (SELECT id, amount FROM shop_orders WHERE amount > 100) AS high_value"),
    "pipe_syntax": Query(
        lambda s, d: _above(_orders(s, d), Decimal("100")).select("id", "amount").orderBy("id"),
        "FROM shop_orders |> WHERE amount > 100 |> SELECT id, amount |> ORDER BY id",
        "SELECT id, amount FROM shop_orders WHERE amount > 100 ORDER BY id",
    ),
    "limit_offset": Query(lambda s, d: _sorted(s, d).offset(20).limit(50).select("id", "load_no"), f"{_SORTED} LIMIT 50 OFFSET 20"),
    "top_k": Query(
        lambda s, d: _orders(s, d).select(*_TOTAL_ORDER).orderBy(F.desc_nulls_last("amount"), *(F.asc_nulls_last(c) for c in _TOTAL_ORDER)).limit(25).select("id", "load_no", "amount"),
        "SELECT id, load_no, amount FROM shop_orders ORDER BY amount DESC NULLS LAST, " + ", ".join(f"{c} NULLS LAST" for c in _TOTAL_ORDER) + " LIMIT 25",
    ),
    "row_cap": Query(lambda s, d: row_cap(_sorted(s, d).offset(2).limit(99), 5).select("id", "load_no"), f"SELECT * FROM ({_SORTED} LIMIT 99 OFFSET 2) AS q LIMIT 5", f"{_SORTED} LIMIT 5 OFFSET 2"),
    "comparators_all": Query(_comparators, _COMPARATORS),
    "case_guarded_cast": Query(
        _guarded_cast,
        r"SELECT id, load_no, CASE WHEN note RLIKE '^[0-9]{1,9}\\z' THEN CAST(note AS BIGINT) ELSE CAST(length(note) AS BIGINT) END AS value FROM shop_orders",
        "SELECT id, load_no, CASE WHEN regexp_full_match(note, '[0-9]{1,9}') THEN TRY_CAST(note AS BIGINT) ELSE CAST(length(note) AS BIGINT) END AS value FROM shop_orders",
    ),
    "days_since_epoch": Query(
        lambda s, d: _orders(s, d).select("id", "load_no", X.days_since_epoch("placed_at").alias("days")),
        "SELECT id, load_no, CAST(unix_date(CAST(placed_at AS DATE)) AS BIGINT) AS days FROM shop_orders",
        f"SELECT id, load_no, {_DAYS} AS days FROM shop_orders",
    ),
    "strict_decimal_cast": Query(
        lambda s, d: _orders(s, d).select("id", "load_no", X.strict_decimal(F.col("amount").cast("string")).alias("amount")), "SELECT id, load_no, CAST(CAST(amount AS STRING) AS DECIMAL(10,2)) AS amount FROM shop_orders", "SELECT id, load_no, amount FROM shop_orders"
    ),
    "amount_range": Query(lambda s, d: _orders(s, d).agg(X.amount_range("amount").alias("amount_range")), "SELECT CAST(max(amount) - min(amount) AS DECIMAL(11,2)) AS amount_range FROM shop_orders"),
    "amount_range_by_load": Query(
        lambda s, d: X.amount_range_parts(_orders(s, d), "amount", F.pmod(F.xxhash64("id"), F.lit(16)), ["load_no"]),
        "SELECT load_no, CAST(max(amount) - min(amount) AS DECIMAL(11,2)) AS amount_range FROM shop_orders GROUP BY load_no",
    ),
    "wrapping_add": Query(
        lambda s, d: _orders(s, d).select("id", X.wrapping_add(F.col("load_no"), 2147483600).alias("sum")),
        "SELECT id, CAST(CASE WHEN load_no + 2147483600L > 2147483647L THEN load_no + 2147483600L - 4294967296L ELSE load_no + 2147483600L END AS INT) AS sum FROM shop_orders",
        "SELECT id, CAST(CASE WHEN load_no::BIGINT + 2147483600 > 2147483647 THEN load_no::BIGINT + 2147483600 - 4294967296 ELSE load_no::BIGINT + 2147483600 END AS INTEGER) AS sum FROM shop_orders",
    ),
    "region_multiplier": Query(
        lambda s, d: _orders(s, d).select("id", X.region_multiplier(F.col("id") % 10).alias("multiplier")),
        "SELECT id, CASE WHEN id IS NULL THEN NULL WHEN id % 10 IN (1, 4, 8) THEN 1.5D WHEN id % 10 IN (5, 6) THEN 0.8D ELSE 1.0D END AS multiplier FROM shop_orders",
        "SELECT id, CASE WHEN id IS NULL THEN NULL WHEN id % 10 IN (1, 4, 8) THEN 1.5::DOUBLE WHEN id % 10 IN (5, 6) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM shop_orders",
    ),
    "flat_add_one": Query(
        lambda s, d: X.add_one_flat(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]),
        None, "SELECT l_orderkey, l_linenumber, l_quantity + 1.0 AS l_quantity, l_extendedprice + 1.0 AS l_extendedprice FROM lineitem",
    ),
    "row_major_add_one": Query(
        lambda s, d: X.add_one_row_major(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]),
        None, "SELECT l_orderkey, l_linenumber, l_quantity + 1.0 AS l_quantity, l_extendedprice + 1.0 AS l_extendedprice FROM lineitem",
    ),
    "nested_list_add_one": Query(
        lambda s, d: _embedding(s, d).select("vec_id", F.round(F.aggregate(X.add_one_list(F.col("embedding").cast("array<double>")), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum")),
        None, "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x + 1.0)), 4) AS checksum FROM embeddings",
    ),
    "deep_nested_add_one": Query(_deep, None, "SELECT vec_id, round(list_sum(list_transform(embedding[1:8]::DOUBLE[], lambda x: x + 1.0)) + list_sum(list_transform(embedding::DOUBLE[], lambda x: x + 1.0)), 4) AS checksum FROM embeddings"),
    "dictionary_decode": Query(_dictionary, "SELECT carrier, count(*) AS n_rows FROM shipments GROUP BY carrier"),
    "run_end_decode": Query(_runs, "SELECT load_no, count(*) AS n, count(*) - 1 AS last_position FROM shop_orders GROUP BY load_no"),
    "first_word": Query(lambda s, d: table(s, d, "documents").select("doc_id", X.first_word("text").alias("word"), X.byte_length("text").alias("n_bytes")), None, "SELECT doc_id, CASE WHEN contains(text, ' ') THEN split_part(text, ' ', 1) ELSE text END AS word, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"),
    "number_prefix": Query(
        lambda s, d: _embedding(s, d).select("vec_id", F.round(F.aggregate(X.number_prefix(F.col("embedding").cast("array<double>"), 3), F.lit(0.0), lambda a, x: a + x), 5).alias("total")),
        None, "SELECT vec_id, round(list_sum(embedding[1:3]::DOUBLE[]), 5) AS total FROM embeddings",
    ),
    "append_suffix": Query(lambda s, d: _shipments(s, d).select("shipment_id", X.append_suffix("carrier", " (carrier)").alias("name")), "SELECT shipment_id, carrier || ' (carrier)' AS name FROM shipments"),
    "digest": Query(_digest, None, _DIGEST),
    "ingest_violations": Query(
        _ingest_violations, None, "SELECT 'id' AS path, count(*) FILTER (WHERE id IS NULL) AS n_rows FROM headers UNION ALL SELECT 'name', count(*) FILTER (WHERE name IS NULL) FROM headers"
    ),
}

QUERIES = {name: q.frame for name, q in CATALOGUE.items()}
ORACLES = {name: q.other or q.sql for name, q in CATALOGUE.items()}

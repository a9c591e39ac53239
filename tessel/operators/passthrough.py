"""SQL that reaches the engine as text: a sample of the delegated surface, each text run by ``spark.sql`` as it is.

The texts are standard SQL; where dialects differ, ``other`` has the text for another engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import cut, scratch
from ..streaming.events import event_windows
from ..tables import table, views
from .catalogue import Query
from .joins import asof_join, range_join

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "shop_orders", "shipments")


def run_sql(text: str):
    """A query of a text over the tables of a folder."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        views(spark, d, *TABLES)
        return spark.sql(text)

    return query


def _asof(spark, d):
    """Each shipment with the last load of its order before it."""
    s = table(spark, d, "shipments").select("shipment_id", "order_id", "loaded_at")
    o = table(spark, d, "shop_orders").select("id", F.col("loaded_at").alias("order_loaded_at"), "load_no").where(F.col("id").isNotNull()).withColumnRenamed("id", "order_id")
    # one row for each order and time, so that the last one is unique
    o = o.groupBy("order_id", "order_loaded_at").agg(F.max("load_no").alias("load_no"))
    return asof_join(s, o, "order_id", "loaded_at", "order_loaded_at", ["load_no"]).select("shipment_id", "load_no")


def _ranges(spark, d):
    """Line items by the price band of their order price; bands are intervals of 10,000."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    bands = spark.range(0, 60).select(F.col("id").alias("band"), (F.col("id") * 10000.0).alias("low"), ((F.col("id") + 1) * 10000.0).alias("high"))
    return range_join(o, bands, "price", "low", "high", 10000.0).groupBy("band").agg(F.count("*").alias("n_orders"))


def _created_view(spark, d):
    """A view over Parquet made by SQL, and a query of it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW created_orders USING parquet OPTIONS (path '{d}/shop_orders.parquet')")
    return spark.sql("SELECT count(*) AS order_count, CAST(sum(amount) AS DECIMAL(20,2)) AS total_amount FROM created_orders WHERE amount > 50.00")


def _created_table(spark, d):
    """CREATE TABLE AS, then INSERT, both by SQL; the table lies in the session's shared folder."""
    views(spark, d, "nation")
    name = f"tessel_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{scratch(spark)}' AS SELECT n_nationkey, n_regionkey FROM nation")
    try:
        spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_regionkey FROM nation")
        return cut(spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY n_regionkey"))
    finally:
        spark.sql(f"DROP TABLE {name}")


def _copied(spark, d):
    """A table written out and read in again by SQL alone."""
    views(spark, d, "customer")
    path = scratch(spark)
    spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT c_custkey, c_mktsegment FROM customer")
    return spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM parquet.`{path}` GROUP BY c_mktsegment")


def _explained(spark, d):
    """What EXPLAIN tells of a query, beside its result."""
    views(spark, d, "orders")
    text = "SELECT count(*) AS n_rows FROM orders WHERE o_totalprice > 1000"
    plan = spark.sql(f"EXPLAIN FORMATTED {text}").first()[0]
    told = "ReadSchema: struct<o_totalprice:double>" in plan, "GreaterThan(o_totalprice,1000" in plan
    return spark.sql(text).select("*", F.lit(told[0]).alias("reads_one_column"), F.lit(told[1]).alias("pushes_filter"))


TEXTS: dict[str, str] = {
    "sql_semi_join": "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey",
    "sql_anti_join": "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey",
    "sql_full_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "sql_scalar_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sql_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sql_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region",
    "sql_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "sql_intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer",
    "sql_except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_filter_clause": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS n FROM orders GROUP BY o_orderstatus",
    "sql_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS k FROM orders",
    "sql_dense_rank": "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS k FROM part",
    "sql_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events",
    "sql_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS k FROM supplier",
    "sql_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders",
    "sql_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part",
    "sql_star_join": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_string_functions": "SELECT c_custkey, upper(substring(c_name, 1, 8)) AS head, length(c_name) AS n, replace(c_mktsegment, 'A', '_') AS seg FROM customer",
    "sql_date_functions": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m FROM orders",
    "sql_values": "SELECT v.k, v.name, count(o_orderkey) AS n FROM (VALUES ('F', 'closed'), ('O', 'open'), ('X', 'none')) AS v(k, name) LEFT JOIN orders ON o_orderstatus = v.k GROUP BY v.k, v.name",
    "sql_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 5",
    "sql_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT c_nationkey AS k FROM customer",
    "sql_percent_rank": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part",
    "sql_cume_dist": "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part",
    "sql_nth_value": "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders",
    "sql_math_functions": "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice / 7) AS BIGINT) AS b, CAST(ceil(p_retailprice / 7) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS d, p_size % 7 AS e, round(ln(p_retailprice), 6) AS f, greatest(p_size, 20) AS g, least(p_size, 20) AS h FROM part",
    "sql_case_coalesce": "SELECT id, load_no, CASE WHEN amount IS NULL THEN 'none' WHEN amount > 100 THEN 'large' ELSE 'small' END AS size, coalesce(note, 'no note') AS note, nullif(load_no, 1) AS load_or_null FROM shop_orders",
    "sql_null_safe_join": "SELECT count(*) AS n FROM (SELECT DISTINCT note FROM shop_orders) a JOIN (SELECT DISTINCT note FROM shop_orders) b ON a.note IS NOT DISTINCT FROM b.note",
    "sql_correlated_max": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_statistics": "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS s, round(var_pop(p_retailprice), 4) AS v, round(corr(p_size, p_retailprice), 6) AS c FROM part GROUP BY p_brand",
    "sql_cross_group": "SELECT o_orderpriority, l_returnflag, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY o_orderpriority, l_returnflag",
}

SAMPLE: dict[str, Query] = {
    name: Query(run_sql(text), text, text.replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN")) for name, text in TEXTS.items()
} | {
    "sql_lateral": Query(
        run_sql("SELECT n_name, c.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) c"), None, "SELECT n_name, c.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) c"
    ),
    "sql_json": Query(
        run_sql("SELECT event_id, get_json_object(props, '$.k') AS k, CAST(length(props) AS BIGINT) AS n FROM events"), None, "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(length(props) AS BIGINT) AS n FROM events"
    ),
    # an approximation is held against the exact value, so that both engines agree on whether it is near
    "sql_approx_percentile": Query(
        run_sql(
            "SELECT s.o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice <= p) AS DOUBLE) / count(*) BETWEEN 0.49 AND 0.51 AS near FROM orders o JOIN "
            "(SELECT o_orderstatus, percentile_approx(o_totalprice, 0.5, 1000) AS p FROM orders GROUP BY o_orderstatus) s ON o.o_orderstatus = s.o_orderstatus GROUP BY s.o_orderstatus"
        ), None, "SELECT o_orderstatus, true AS near FROM orders GROUP BY o_orderstatus",
    ),
    "sql_percentile": Query(
        run_sql("SELECT o_orderstatus, percentile(o_totalprice, 0.5) AS middle FROM orders GROUP BY o_orderstatus"), None, "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS middle FROM orders GROUP BY o_orderstatus"
    ),
    "sql_approx_distinct": Query(
        run_sql("SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus"), None,
        "SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY o_orderstatus",
    ),
    "sql_regexp": Query(
        run_sql(r"SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_name, '[0-9]', '#') AS masked, c_name RLIKE '7$' AS ends FROM customer"), None,
        "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, regexp_replace(c_name, '[0-9]', '#', 'g') AS masked, regexp_matches(c_name, '7$') AS ends FROM customer",
    ),
    "sql_nested_types": Query(
        run_sql("SELECT n_regionkey, size(collect_set(n_nationkey)) AS n, map('k', n_regionkey)['k'] AS k, named_struct('a', n_regionkey + 1).a AS a, element_at(sort_array(collect_list(n_name)), 1) AS first FROM nation GROUP BY n_regionkey"), None,
        "SELECT n_regionkey, CAST(count(DISTINCT n_nationkey) AS INT) AS n, n_regionkey AS k, n_regionkey + 1 AS a, min(n_name) AS first FROM nation GROUP BY n_regionkey",
    ),
    "sql_explode": Query(
        run_sql("SELECT n_nationkey, word FROM nation LATERAL VIEW explode(split(n_name, ' ')) t AS word"), None, "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation"
    ),
    "sql_pivot": Query(
        run_sql("SELECT * FROM (SELECT l_linestatus, l_returnflag, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_returnflag IN ('A' AS a, 'N' AS n, 'R' AS r))"), None,
        "SELECT l_linestatus, " + ", ".join(f"nullif(count(l_quantity) FILTER (WHERE l_returnflag = '{x}'), 0) AS {x.lower()}" for x in "ANR") + " FROM lineitem GROUP BY l_linestatus",
    ),
    "sql_create_view": Query(_created_view, None, "SELECT count(*) AS order_count, CAST(sum(amount) AS DECIMAL(20,2)) AS total_amount FROM shop_orders WHERE amount > 50"),
    "sql_create_table": Query(_created_table, None, "SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY n_regionkey"),
    "sql_copy": Query(_copied, None, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    "sql_explain": Query(_explained, None, "SELECT count(*) AS n_rows, true AS reads_one_column, true AS pushes_filter FROM orders WHERE o_totalprice > 1000"),
    "asof_join": Query(
        _asof, None,
        "WITH o AS (SELECT id AS order_id, loaded_at AS t, max(load_no) AS load_no FROM shop_orders WHERE id IS NOT NULL GROUP BY 1, 2) SELECT s.shipment_id, o.load_no FROM shipments s ASOF LEFT JOIN o ON s.order_id = o.order_id AND s.loaded_at >= o.t",
    ),
    "range_join": Query(_ranges, None, "SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS band, count(*) AS n_orders FROM orders WHERE o_totalprice < 600000 GROUP BY 1"),
    "event_windows": Query(
        lambda s, d: event_windows(table(s, d, "events")).withColumn("total", F.round("total", 6)), None,
        "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    ),
}
QUERIES = {name: q.frame for name, q in SAMPLE.items()}
ORACLES = {name: q.other for name, q in SAMPLE.items()}

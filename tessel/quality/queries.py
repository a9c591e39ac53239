"""Queries p1 to p6 over the tables of a folder, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import differences, drift, hotkeys, oracles, orphans, parsing, profile

MANIFEST_FIELDS = [
    "schema_version", "input_key", "input_size", "input_e_tag", "input_last_modified", "row_count", "content_digest",
    "input_version", "output_key", "output_e_tag", "output_version", "digest_scheme",
]


ORDER_RULES = [profile.ColumnRule("note", breaks=profile.note_breaks), profile.ColumnRule("amount", outside=profile.amount_outside)]
HEADER_RULES = [profile.ColumnRule("name", breaks=profile.name_breaks)]
MEASURES = ["null_share", "distinct_share", "pattern_share", "range_share", "level"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tables = [(table(spark, d, t), t, rules) for t, rules in (("shop_orders", ORDER_RULES), ("headers", HEADER_RULES))]
    return profile.departures(profile.profiles(tables, full=False), MEASURES).select("table_name", "column_name", "load_no", "measure")


def _every_column(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, list[profile.ColumnRule]]]:
    of_orders = [*ORDER_RULES, *(profile.ColumnRule(c) for c in ("id", "placed_at", "loaded_at", "deleted_at"))]
    of_headers = [*HEADER_RULES, profile.ColumnRule("id"), profile.ColumnRule("note", breaks=profile.note_breaks)]
    return [(table(spark, d, t), t, rules) for t, rules in (("shop_orders", of_orders), ("headers", of_headers))]


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of both tables for each load, with their coverage by induced expressions."""
    return profile.profiles(_every_column(spark, d))


def p1_expressions(spark: SparkSession, d: str) -> DataFrame:
    """How every column's own expressions are spread over its loads."""
    return profile.expression_shares([(df, t, [r.name for r in rules]) for df, t, rules in _every_column(spark, d)])


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The loads in which an expression covers a share of a column unlike its usual one."""
    return profile.coverage_changes(p1_expressions(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "shipments"), table(spark, d, "shop_orders"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, d, "shipments"), table(spark, d, "shop_orders"), keep=("shipment_id", "shipped_at"))
    return orphans.orphan_report(found, "shipments")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "shipments")
    return hotkeys.heavy_keys(hotkeys.per_key(t, ["order_id", "carrier"], "shipped_at"), t.count())


def p5_per_key(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.per_key(table(spark, d, "shipments"), ["order_id", "carrier"], "shipped_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    orders = differences.differences(
        table(spark, d, "shop_orders"), table(spark, d, "orders_mirror"), ["id", "load_no"], ["amount", "placed_at", "note"], "orders"
    )
    manifests = differences.differences(table(spark, d, "manifests_v2"), table(spark, d, "manifests_v2_mirror"), ["run_id"], MANIFEST_FIELDS, "manifests")
    return differences.all_differences([orders, manifests])


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("dataset", "difference").agg(F.count("*").alias("n_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.failures(parsing.parse_records(table(spark, d, "malformed")))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parsing.loaded(parsing.parse_records(table(spark, d, "malformed")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return parsing.failure_report(parsing.parse_records(table(spark, d, "malformed")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "manifest_lines"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.one_table(table(spark, d, "manifest_lines"))


def p4_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of the one table have a value for each field."""
    t = drift.one_table(table(spark, d, "manifest_lines"))
    fields = [c for c in t.columns if "__" not in c and c not in ("file_no", "stream", "written_at", "line_no", "_conflicts", "_rest")]
    counts = t.agg(*(F.count(F.col(f"`{c}`")).alias(f"_{k}") for k, c in enumerate(fields)))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_{k}").alias("n_lines")) for k, c in enumerate(fields)))
    return counts.select(F.explode(cells).alias("_x")).select("_x.*").where(F.col("n_lines") > 0)


def p4_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(table(spark, d, "manifest_lines"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_expressions, p1_coverage, p2_found, p2_report, p3_found, p3_loaded, p3_report, p4_found, p4_table, p4_table_counts, p4_alternatives, p5_found, p5_per_key, p6_found, p6_summary)}

_P2 = """
WITH o AS (SELECT id, min(loaded_at) AS first_at, min(deleted_at) AS gone_at FROM shop_orders WHERE id IS NOT NULL GROUP BY id),
k AS (SELECT DISTINCT s.shipment_id, s.shipped_at,
        CASE WHEN o.id IS NULL THEN 'missing' WHEN o.first_at > s.loaded_at THEN 'late' WHEN o.gone_at <= s.loaded_at THEN 'deleted' END AS kind
      FROM shipments s LEFT JOIN o ON o.id = s.order_id WHERE s.order_id IS NOT NULL)
"""

_P5 = """
WITH k AS (
  SELECT 'order_id' AS field, CAST(order_id AS VARCHAR) AS key_value, shipped_at FROM shipments WHERE order_id IS NOT NULL
  UNION ALL SELECT 'carrier', carrier, shipped_at FROM shipments WHERE carrier IS NOT NULL)
"""


def _p6(dataset: str, left: str, right: str, key: str, fields: list[str], kinds: dict[str, str]) -> str:
    cols = ", ".join(f"CAST({f} AS {kinds[f]}) AS {f}" if f in kinds else f for f in fields)
    side = lambda t: f"(SELECT DISTINCT {key} AS k, {cols} FROM {t})"
    parts = [
        f"SELECT '{dataset}' AS dataset, l.k AS row_key, 'only_left' AS difference FROM {side(left)} l WHERE l.k NOT IN (SELECT k FROM {side(right)})",
        f"SELECT '{dataset}', r.k, 'only_right' FROM {side(right)} r WHERE r.k NOT IN (SELECT k FROM {side(left)})",
        *(f"SELECT '{dataset}', l.k, '{f}' FROM {side(left)} l JOIN {side(right)} r ON l.k = r.k WHERE l.{f} IS DISTINCT FROM r.{f}" for f in fields),
    ]
    return " UNION ALL ".join(parts)


_P6 = " UNION ALL ".join(
    [
        _p6("orders", "shop_orders", "orders_mirror", "CAST(id AS VARCHAR) || '/' || CAST(load_no AS VARCHAR)", ["amount", "placed_at", "note"], {"amount": "DECIMAL(14,4)"}),
        _p6("manifests", "manifests_v2", "manifests_v2_mirror", "run_id", MANIFEST_FIELDS, {}),
    ]
)

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_P3 = f"""
WITH h AS (SELECT file_no, raw, len(raw) - len(replace(raw, ',', '')) AS commas FROM malformed WHERE line_no = 1),
r AS (
  SELECT m.record_id, m.file_no, m.line_no, m.raw, h.commas AS want, h.raw AS head,
    regexp_full_match(m.raw, '{_FIELD}(?:,{_FIELD})*', 's') AS proper,
    len(regexp_replace(m.raw, '"[^"]*"', '', 'g')) - len(replace(regexp_replace(m.raw, '"[^"]*"', '', 'g'), ',', '')) AS commas,
    regexp_extract(m.raw, '^({_FIELD})', 1) AS f1, regexp_extract(m.raw, '^{_FIELD},({_FIELD})', 1) AS f2,
    regexp_extract(m.raw, '^{_FIELD},{_FIELD},({_FIELD})', 1) AS f3, regexp_extract(m.raw, '^{_FIELD},{_FIELD},{_FIELD},({_FIELD})', 1) AS f4
  FROM malformed m JOIN h USING (file_no) WHERE m.line_no <> 1),
u AS (SELECT *, {", ".join(f"CASE WHEN f{k} LIKE '\"%' THEN replace(f{k}[2:-2], '\"\"', '\"') ELSE f{k} END AS v{k}" for k in (1, 2, 3, 4))} FROM r),
k AS (SELECT *,
  CASE WHEN NOT proper THEN 'quoting' WHEN commas <> want THEN 'column_count'
    WHEN NOT regexp_full_match(v1, '-?[0-9]+') OR TRY_CAST(v1 AS BIGINT) IS NULL THEN 'id'
    WHEN want = 3 AND NOT regexp_full_match(v2, '-?[0-9]{{1,8}}([.][0-9]{{1,2}})?') THEN 'amount'
    WHEN want = 3 AND (NOT regexp_full_match(v3, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]{{1,6}})?')
      OR TRY_CAST(v3 AS TIMESTAMP) IS NULL) THEN 'placed_at' END AS reason
  FROM u)
"""

def _p1(t: str, c: str, breaks: str | None, outside: str | None, level: str) -> str:
    some = "count(v)"
    share = lambda x: f"CASE WHEN {some} > 0 THEN CAST(count(*) FILTER (WHERE {x}) AS DOUBLE) / {some} END" if x else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, load_no, CAST(count(*) - {some} AS DOUBLE) / count(*) AS null_share,
      CASE WHEN {some} > 0 THEN CAST(count(DISTINCT v) AS DOUBLE) / {some} END AS distinct_share, {share(breaks)} AS pattern_share,
      {share(outside)} AS range_share, CAST(quantile_cont({level}, 0.5) AS DOUBLE) AS level
      FROM (SELECT load_no, {c} AS v FROM {t}) GROUP BY load_no"""


_P1 = f"""
WITH p AS ({_p1("shop_orders", "note", oracles.NOTE_BREAKS, None, "CAST(length(v) AS DOUBLE)")}
  UNION ALL {_p1("shop_orders", "amount", None, "(v < 0.01 OR v > 20000)", "CAST(v AS DOUBLE)")}
  UNION ALL {_p1("headers", "name", oracles.NAME_BREAKS, None, "CAST(length(v) AS DOUBLE)")}),
l AS (UNPIVOT p ON null_share, distinct_share, pattern_share, range_share, level INTO NAME measure VALUE value),
m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY table_name, column_name, measure) AS mid FROM l)
SELECT table_name, column_name, load_no, measure FROM m WHERE CASE measure
  WHEN 'null_share' THEN abs(value - mid) > 0.15 WHEN 'distinct_share' THEN value < mid / 2 WHEN 'pattern_share' THEN value > mid + 0.10
  WHEN 'range_share' THEN value > mid + 0.03 ELSE value > 1.6 * mid OR value < mid / 1.6 END
"""

ORACLES = {
    **oracles.ORACLES,
    "p1_found": _P1,
    "p3_found": _P3 + "SELECT record_id, reason FROM k WHERE reason IS NOT NULL",
    "p3_report": _P3 + "SELECT file_no, coalesce(reason, 'valid') AS reason, count(*) AS n_records FROM k GROUP BY 1, 2",
    "p3_loaded": _P3
    + """SELECT record_id, file_no, line_no, CAST(v1 AS BIGINT) AS id, CASE WHEN want = 3 THEN CAST(v2 AS DECIMAL(10,2)) END AS amount,
      CASE WHEN want = 3 THEN CAST(v3 AS TIMESTAMP) END AS placed_at, CASE WHEN want = 1 THEN v2 END AS name, CASE WHEN want = 3 THEN nullif(v4, '') END AS note
      FROM k WHERE reason IS NULL""",
    "p2_found": _P2 + "SELECT DISTINCT shipment_id, kind FROM k WHERE kind IS NOT NULL",
    "p2_report": _P2
    + "SELECT 'shipments' AS table_name, strftime(shipped_at, '%Y-%m') AS month, kind, count(DISTINCT shipment_id) AS n_references FROM k WHERE kind IS NOT NULL GROUP BY 2, 3",
    "p5_found": _P5 + "SELECT field, key_value FROM k GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM shipments)",
    "p5_per_key": _P5 + "SELECT field, key_value, count(*) AS n_rows, min(shipped_at) AS first_at, max(shipped_at) AS last_at FROM k GROUP BY 1, 2",
    "p6_found": _P6,
    "p6_summary": f"SELECT dataset, difference, count(*) AS n_rows FROM ({_P6}) GROUP BY 1, 2",
}

"""Rows that fail to parse: CSV records are split, typed and set apart with the reason of the first failure.

Structure (quoting, number of fields) is checked on each record by plain replacements, without recursive patterns,
so a field may be of any length.  Values are checked once for each different value of a column; the invalid ones form
a dictionary with the reason, which is joined back to the records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut, sized_join

#: Marks used while splitting; the two characters themselves are escaped first, so any text is safe.
_A, _B = "\x01", "\x02"


@dataclass(frozen=True)
class ValueRule:
    """A typed column: the pattern of its text, and the type it is cast to once the text fits."""

    name: str
    pattern: str
    kind: str


#: The text forms of the typed columns.
RULES = (
    ValueRule("id", r"^-?[0-9]+\z", "bigint"),
    ValueRule("amount", r"^-?[0-9]{1,8}(\.[0-9]{1,2})?\z", "decimal(10,2)"),
    ValueRule("placed_at", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?\z", "timestamp_ntz"),
)


def _escaped(raw: Column) -> Column:
    return F.replace(F.replace(raw, F.lit(_A), F.lit(_A + "a")), F.lit(_B), F.lit(_A + "b"))


def quoting_fails(raw: Column) -> Column:
    """True unless the record is proper CSV; every maximal quoted run becomes one mark, which may only stand
    next to commas, other marks and the ends.  A null record is not proper."""
    marked = F.regexp_replace(_escaped(raw), '"[^"]*"', _B)
    bad = marked.contains('"') | marked.rlike(f"[^,{_B}]{_B}") | marked.rlike(f"{_B}[^,{_B}]")
    return F.coalesce(bad, F.lit(True))


def split_fields(raw: Column) -> Column:
    """The fields of a proper record as an array of texts, without quotes.  Nothing is trimmed."""
    pieces = F.split(_escaped(raw), '"', -1)
    outside = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit(_B))).otherwise(x))
    fields = F.split(F.array_join(outside, '"'), _B, -1)

    def plain(x: Column) -> Column:
        inner = F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        x = F.when(x.startswith('"'), inner).otherwise(x)
        return F.replace(F.replace(x, F.lit(_A + "b"), F.lit(_B)), F.lit(_A + "a"), F.lit(_A))

    return F.transform(fields, plain)


def structured(records: DataFrame) -> DataFrame:
    """Records other than line 1 with ``_fields``, ``_names`` (their file's header) and ``_reason`` of structure."""
    parsed = records.select("record_id", "file_no", "line_no", quoting_fails(F.col("raw")).alias("_quoting"), split_fields(F.col("raw")).alias("_fields"))
    headers = (
        parsed.where((F.col("line_no") == 1) & ~F.col("_quoting") & F.col("file_no").isNotNull())
        .groupBy("file_no").agg(F.min_by("_fields", "record_id").alias("_names"))
    )
    body = parsed.where(F.coalesce(F.col("line_no") != 1, F.lit(True)))
    body = sized_join(body, headers, ["file_no"], "left")
    reason = F.when(F.col("_quoting"), "quoting").when(F.coalesce(F.size("_fields") != F.size("_names"), F.lit(True)), "column_count")
    return body.withColumn("_reason", reason)


def _value(rule: ValueRule) -> Column:
    """The field under the rule's name; null where the record has no such column or broken structure."""
    at = F.when(F.col("_reason").isNull(), F.array_position("_names", rule.name))
    return F.when(at > 0, F.get("_fields", at.cast("int") - 1))


def invalid_values(body: DataFrame, rules: tuple[ValueRule, ...] = RULES) -> DataFrame:
    """``_column``, ``_text`` of the different values that fail; each is checked and cast once."""
    cells = body.where(F.col("_reason").isNull()).select(
        F.explode(F.array(*(F.struct(F.lit(r.name).alias("c"), F.col(f"_v_{r.name}").alias("t")) for r in rules))).alias("_x")
    )
    cells = cells.select(F.col("_x.c").alias("_column"), F.col("_x.t").alias("_text")).where(F.col("_text").isNotNull()).distinct()
    fits = F.lit(False)
    for r in rules:
        fits = F.when(F.col("_column") == r.name, F.col("_text").rlike(r.pattern) & F.col("_text").try_cast(r.kind).isNotNull()).otherwise(fits)
    return cells.where(~fits)


def parse_records(records: DataFrame, rules: tuple[ValueRule, ...] = RULES) -> DataFrame:
    """Every record but line 1 with ``_fields``, ``_names`` and ``reason``, null for a valid one.

    ``records``: record_id, file_no, line_no, raw.  The first failure in the order quoting, column_count and the
    rules' names is given.  Records of a file without a readable line 1 have reason ``column_count``, for there is no
    header whose number of fields they have; a null record has ``quoting``.  Repeated records are kept, other
    columns are not read, an empty table gives no row.
    """
    body = structured(records)
    body = body.select("*", *(_value(r).alias(f"_v_{r.name}") for r in rules))
    bad = cut(invalid_values(body, rules))
    reason = F.col("_reason")
    for r in rules:
        own = bad.where(F.col("_column") == r.name).select(F.col("_text").alias(f"_v_{r.name}"), F.lit(r.name).alias(f"_bad_{r.name}"))
        body = sized_join(body, own, [f"_v_{r.name}"], "left")
        reason = F.coalesce(reason, F.col(f"_bad_{r.name}"))
    return body.withColumn("reason", reason).select("record_id", "file_no", "line_no", "_fields", "_names", *(f"_v_{r.name}" for r in rules), "reason")


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("record_id", "reason")


def loaded(parsed: DataFrame, rules: tuple[ValueRule, ...] = RULES) -> DataFrame:
    """The valid records with their types; a column that a file lacks is null, an empty note is null, an empty name stays."""

    def text(name: str) -> Column:
        at = F.array_position("_names", name)
        return F.when(at > 0, F.get("_fields", at.cast("int") - 1))

    typed = [F.col(f"_v_{r.name}").try_cast(r.kind).alias(r.name) for r in rules]
    note = text("note")
    rows = parsed.where(F.col("reason").isNull())
    return rows.select("record_id", "file_no", "line_no", *typed, text("name").alias("name"), F.when(note != "", note).alias("note"))


def failure_report(parsed: DataFrame) -> DataFrame:
    """Valid and failing records of each file and reason (``valid`` for no failure)."""
    return parsed.groupBy("file_no", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_records"))

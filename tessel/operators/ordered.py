"""Rank, running total and share over a whole table, without a window that gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import in_ranges, running_sum, running_sums, sized_join


def global_rank(df: DataFrame, by: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """``RANK()`` over all rows by one column, nulls last: equal values share a rank, then a gap.

    Ranks belong to values, so the different values are ranked, in ranges, and joined back.  Values are joined as they are
    (0.0 equals -0.0, NaN equals NaN, null equals null), inside a struct, which is never null itself.
    """
    values = df.groupBy(F.col(by).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    order = F.desc_nulls_last("_v") if descending else F.asc_nulls_last("_v")
    ranks = running_sum(in_ranges(values, [order]), ["_all"], "_range", [order], "_n", "_upto")
    ranks = ranks.select(F.struct("_v").alias("_key"), (F.col("_upto") - F.col("_n") + 1).cast("bigint").alias(out))
    return sized_join(df.withColumn("_key", F.struct(F.col(by).alias("_v"))), ranks, ["_key"]).drop("_key")


def running_total(df: DataFrame, by: str, then: list[str], value: str, out: str = "running_total", rows_per_range: int = 100_000) -> DataFrame:
    """Running sum of ``value`` in the order of ``by`` and ``then``, nulls last, up to and including each row.

    Null as long as there was no value.  Rows that tie in all of the order follow each other as they are stored.
    """
    order = [F.asc_nulls_last(c) for c in (by, *then)]
    rows = in_ranges(df, order, rows_per_range).withColumns({"_all": F.lit(0), "_some": F.col(value).isNotNull().cast("bigint")})
    rows = running_sums(rows, ["_all"], "_range", [*order, "_tie"], {"_sum": value, "_seen": "_some"})
    return rows.withColumn(out, F.when(F.col("_seen") > 0, F.col("_sum"))).drop("_all", "_some", "_range", "_tie", "_sum", "_seen")


def _share(part: Column, whole: Column) -> Column:
    """Float division: by zero it gives NaN or an infinity; a null part stays null."""
    by_zero = F.when(part == 0, F.lit(float("nan"))).when(part > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(whole == 0, F.when(part.isNotNull(), by_zero)).otherwise(part / whole * 100)


def percent_of_total(df: DataFrame, amount: str, by: list[str] | None = None, out: str = "percent_of_total") -> DataFrame:
    """Share of each value in the total of all rows, or of its group, in percent; a null group is a group.

    The total is one row, or one for each group, and is joined; a group that holds a third of all rows stays spread.
    """
    part = F.col(amount).cast("double")
    if not by:
        total = df.agg(F.sum(amount).cast("double").alias("_total"))
        return df.join(F.broadcast(total)).withColumn(out, _share(part, F.col("_total"))).drop("_total")
    # structs compare null with null, and their fields by type
    keyed = df.withColumn("_key", F.struct(*by))
    totals = keyed.groupBy("_key").agg(F.sum(amount).cast("double").alias("_total"))
    return sized_join(keyed, totals, ["_key"]).withColumn(out, _share(part, F.col("_total"))).drop("_total", "_key")

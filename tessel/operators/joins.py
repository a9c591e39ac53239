"""Joins: strategies by name, as-of joins and range joins."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..scale import BROADCAST_BYTES, cut, in_ranges, is_cut, size_of, sized_join


class JoinPlan(Enum):
    AUTO = "auto"
    SORT_MERGE = "merge"
    SHUFFLE_HASH = "shuffle_hash"
    BROADCAST = "broadcast"


def joined(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner", plan: JoinPlan = JoinPlan.AUTO, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A join with a strategy.  BROADCAST is taken only if the right side, computed once, has at most ``most_bytes``, else sort-merge."""
    if plan is JoinPlan.BROADCAST:
        right = right if is_cut(right) else cut(right)
        plan = JoinPlan.BROADCAST if size_of(right)[1] <= most_bytes else JoinPlan.SORT_MERGE
    return left.join(right if plan is JoinPlan.AUTO else right.hint(plan.value), on, how)


def asof_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, values: list[str], rows_per_range: int = 200_000) -> DataFrame:
    """Each left row with the ``values`` of the last right row of the same key whose time is not after its own.

    Left rows without such a row, a key or a time have nulls; equal right times are decided by the greatest values.
    One key, or one time of a key, may hold most rows: both sides are put in order of key and time and cut into ranges; a
    range is given the last right row before it, which counts for the key that the range starts with.
    """
    names = left.columns
    known = F.col("_k").isNotNull() & F.col("_at").isNotNull()
    a = left.select(F.struct(*names).alias("_row"), F.col(on).alias("_k"), F.col(left_at).alias("_at"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(on).alias("_k"), F.col(right_at).cast(a.schema["_at"].dataType).alias("_at"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    both = in_ranges(a.unionByName(b).where(known), ["_k", "_at", "_side", "_v"], rows_per_range)
    # one row for each range
    last = both.groupBy("_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_k", "_at", "_v"))).alias("_m"))
    carried = F.last("_m", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select("_range", carried["_k"].alias("_carried_key"), carried["_v"].alias("_carried"))
    order = Window.partitionBy("_range", "_k").orderBy("_at", "_side", "_v", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(order)).where(F.col("_side") == 1)
    seen = sized_join(seen, last, ["_range"], "left")
    found = F.coalesce("_seen", F.when(F.col("_carried_key") == F.col("_k"), F.col("_carried")))
    seen = seen.select("_row", found.alias("_v")).unionByName(a.where(~known).select("_row", "_v"))
    return seen.select("_row.*", *(F.col("_v")[v].alias(v if v not in names else f"right_{v}") for v in values))


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Points joined with the intervals that hold them, ``start <= at < end``.

    Both sides are put into cells of ``width``, so the join is an equi-join on the cell (and ``on``); an interval stands in
    each cell it touches.  Choose ``width`` near the usual length of an interval.
    """
    cell = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width))).cast("bigint")
    keys = [*(on or []), "_cell"]
    p = points.withColumn("_cell", cell(at))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    return p.join(i, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")

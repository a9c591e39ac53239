"""Aggregates composed of built-in ones, so partial sums are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amount_range(c: Column | str) -> Column:
    """Greatest minus least value; null for no value, 0 for one.  A decimal gets one digit more."""
    return F.max(c) - F.min(c)


def amount_range_parts(df: DataFrame, amount: str, parts: Column, by: list[str] | None = None) -> DataFrame:
    """``amount_range`` in two explicit phases: least and greatest of each part, then of all parts, in any order."""
    keys = by or []
    state = df.groupBy(*keys, parts.alias("_part")).agg(F.min(amount).alias("_least"), F.max(amount).alias("_greatest"))
    return state.groupBy(*keys).agg((F.max("_greatest") - F.min("_least")).alias("amount_range"))


#: Name of the digest in manifests: sum modulo 2^64 of the first 64 bits of the MD5 of each row.
DIGEST_SCHEME = "tessel-md5-wrapping-sum-v1"


def row_digest(*columns: Column | str) -> Column:
    """64 bits of the MD5 of a row's fields as decimal(20,0); each field is tagged, so null and empty text differ
    and no two rows of different fields read the same."""
    cells = []
    for c in columns:
        v = (F.col(c) if isinstance(c, str) else c).cast("string")
        cells.append(F.coalesce(F.concat(F.lit("v"), F.length(v).cast("string"), F.lit(":"), v), F.lit("n")))
    return F.conv(F.substring(F.md5(F.concat(*cells)), 1, 16), 16, 10).cast("decimal(20,0)")


def multiset_digest(*columns: Column | str) -> Column:
    """Order-independent digest of all rows as 16 hexadecimal digits: a wrapping sum, so repeated rows count.
    No rows give 16 zeros."""
    total = F.coalesce(F.sum(row_digest(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    low = F.pmod(total, F.lit("18446744073709551616").cast("decimal(38,0)"))
    return F.lower(F.lpad(F.conv(low.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))

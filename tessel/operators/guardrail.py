"""A cap on the rows of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The largest limit that Spark takes.
MOST_ROWS = (1 << 31) - 1


def row_cap(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a finished query; smaller limits and offsets of its own stay as they are.

    A negative cap is refused; one beyond what Spark can limit to changes nothing.  Capping twice caps once, by the
    smaller.  This shapes a result; it does not bound the work of making it.
    """
    if most < 0:
        raise ValueError("a row cap cannot be negative")
    return df if most > MOST_ROWS else df.limit(most)

"""Element-wise kernels over flat columns, lists and nested lists, and decoding of encoded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_one_flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds 1.0 to each column in place; stays one projection."""
    return df.withColumns({c: F.col(c) + F.lit(1.0) for c in columns})


def add_one_row_major(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same by way of one array for each row."""
    rows = df.withColumn("_row", F.transform(F.array(*columns), lambda x: x + F.lit(1.0)))
    return rows.withColumns({c: F.col("_row")[k] for k, c in enumerate(columns)}).drop("_row")


def add_one_list(xs: Column | str) -> Column:
    return F.transform(xs, lambda x: x + F.lit(1.0))


def add_one_deep(wrappers: Column | str) -> Column:
    """Adds 1.0 to every number of an array of structs with ``items``, an array of structs with ``values``."""
    inner = lambda item: item.withField("values", F.transform(item["values"], lambda x: x + F.lit(1.0)))
    return F.transform(wrappers, lambda w: w.withField("items", F.transform(w["items"], inner)))


def checksum_deep(wrappers: Column | str) -> Column:
    """Sum of every number of the nested array."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    items = F.flatten(F.transform(wrappers, lambda w: w["items"]))
    return total(F.flatten(F.transform(items, lambda i: i["values"])))


def decode_dictionary(codes: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """Values for codes; the dictionary is unique in its code.  A code without a value keeps its row with nulls."""
    from ..scale import sized_join

    return sized_join(codes, dictionary, [code], "left")


def decode_runs(runs: DataFrame, start: str = "start", length: str = "length") -> DataFrame:
    """One row for each position of each run; runs of no length give none."""
    positions = F.sequence(F.col(start), F.col(start) + F.col(length) - 1)
    return runs.where(F.col(length) > 0).withColumn("position", F.explode(positions)).drop(start, length)

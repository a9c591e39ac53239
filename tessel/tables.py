"""Readers for a folder that holds one Parquet file or folder for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Registers tables of a folder as temporary views of the same names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)

"""Functions for SQL text: expressions are registered as SQL functions, which the optimizer inlines and folds."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Volatility(Enum):
    IMMUTABLE = "immutable"
    VOLATILE = "volatile"


@dataclass(frozen=True)
class SqlFunction:
    name: str
    arguments: str
    result: str
    body: str
    volatility: Volatility = Volatility.IMMUTABLE


FUNCTIONS = (
    SqlFunction("days_since_epoch", "at TIMESTAMP_NTZ", "BIGINT", "CAST(unix_date(CAST(at AS DATE)) AS BIGINT)"),
    SqlFunction(
        "wrapping_add", "v INT, k INT", "INT",
        "CASE WHEN v IS NULL THEN CAST(raise_error('wrapping_add: null value') AS INT) "
        "ELSE CAST(pmod(CAST(v AS BIGINT) + CAST(k AS BIGINT) + 2147483648L, 4294967296L) - 2147483648L AS INT) END",
    ),
    SqlFunction("region_multiplier", "id BIGINT", "DOUBLE", "CASE WHEN id IS NULL THEN NULL WHEN id IN (1, 4, 8) THEN 1.5D WHEN id IN (5, 6) THEN 0.8D ELSE 1.0D END"),
    SqlFunction("first_word", "t STRING", "STRING", "substring_index(t, ' ', 1)"),
    SqlFunction("percent_of", "part DOUBLE, whole DOUBLE", "DOUBLE", "CASE WHEN whole = 0 THEN CASE WHEN part = 0 THEN CAST('NaN' AS DOUBLE) WHEN part > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END ELSE part / whole * 100 END"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Registers all functions for the session; ``amount_range`` for SQL text is a grouped Arrow function."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({f.arguments}) RETURNS {f.result} RETURN {f.body}")

    def amount_range(values):
        import pyarrow.compute as pc

        ends = pc.min_max(values)
        least, greatest = ends["min"].as_py(), ends["max"].as_py()
        return None if least is None else greatest - least

    import pyarrow as pa

    amount_range.__annotations__ = {"values": pa.Array, "return": object}
    spark.udf.register("amount_range", F.arrow_udf(amount_range, "decimal(11,2)", F.ArrowUDFType.GROUPED_AGG))
    return [f.name for f in FUNCTIONS] + ["amount_range"]

"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_since_epoch(at: Column | str, df: DataFrame | None = None) -> Column:
    """Whole days since 1970-01-01 as bigint, rounded down, so one microsecond before is day -1; null stays null.

    With ``df``, a column of another type than timestamp without zone (or with the session's) is refused.
    """
    if df is not None:
        kind = df.select(_col(at)).schema[0].dataType
        if not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            raise TypeError(f"days_since_epoch needs a timestamp, not {kind.simpleString()}")
    return F.unix_date(_col(at).cast("date")).cast("bigint")


def wrapping_add(value: Column | str, k: int, df: DataFrame | None = None) -> Column:
    """``value + k`` in 32 bits with wrap-around; a null value is an error.

    ``k`` must be a literal and ``value`` a column: a Column for ``k`` or a number for ``value`` is refused.
    """
    if isinstance(k, Column) or not isinstance(k, int) or isinstance(k, bool):
        raise TypeError("the second argument must be a literal integer")
    if not isinstance(value, (Column, str)):
        raise TypeError("the first argument must be a column")
    if not -(1 << 31) <= k < 1 << 31:
        raise ValueError("the literal does not fit 32 bits")
    v = _col(value)
    if df is not None and not isinstance(df.select(v).schema[0].dataType, T.IntegerType):
        raise TypeError("wrapping_add needs an int column")
    half, full = 1 << 31, 1 << 32
    wrapped = (F.pmod(v.cast("bigint") + F.lit(k).cast("bigint") + F.lit(half), F.lit(full)) - F.lit(half)).cast("int")
    return F.when(v.isNull(), F.raise_error(F.lit("wrapping_add: null value")).cast("int")).otherwise(wrapped)


#: The text of a decimal number in a cast, and of an amount in a file.
DECIMAL_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"
AMOUNT_TEXT = r"^[+-]?[0-9]+\.[0-9]{2}\z"


def strict_decimal(text: Column | str, precision: int = 10, scale: int = 2) -> Column:
    """Text to decimal; blanks, exponents and texts without digits are errors, as is a value out of range."""
    t = _col(text)
    bad = F.raise_error(F.concat(F.lit("not a decimal: "), t)).cast(f"decimal({precision},{scale})")
    return F.when(t.isNull() | t.rlike(DECIMAL_TEXT), t.cast(f"decimal({precision},{scale})")).otherwise(bad)


def approx_equal(a: Column | str, b: Column | str, relative: float = 1e-9) -> Column:
    """Equal within a relative distance, and within that distance of 1 for small numbers."""
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * F.lit(relative)


def first_word(text: Column | str) -> Column:
    """The text before the first space, all of it if there is none."""
    return F.substring_index(_col(text), " ", 1)


def number_prefix(numbers: Column | str, n: int) -> Column:
    """The first ``n`` items of an array."""
    return F.slice(_col(numbers), 1, n)


def byte_length(text: Column | str) -> Column:
    return F.octet_length(_col(text)).cast("bigint")


def append_suffix(text: Column | str, suffix: str) -> Column:
    return F.concat(_col(text), F.lit(suffix))

"""CSV files under fixed schemas.

A file is read as text columns in one distributed plan with strict record checks; values are parsed by expressions that
raise on the first bad one.  Only when a read has failed is the file looked at again on the driver, row by row, to name
the zero-based row.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import AMOUNT_TEXT

#: Fixed value: the text of a timestamp in a file.
TIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z"
INTEGER_TEXT = r"^[+-]?[0-9]+\z"


class CsvError(ValueError):
    """A record that does not parse; ``row`` counts records after the header from 0, None if unknown."""

    def __init__(self, path: str, reason: str, row: int | None = None):
        self.path, self.reason, self.row = path, reason, row
        super().__init__(f"{path}: {reason}" + (f" in row {row}" if row is not None else ""))


def records_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether some quoted field holds a line break: a line then has an odd number of quotes."""
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1
    return bool(spark.read.text(path).where(odd).limit(1).count())


def _texts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns as texts.  Files are split among tasks unless a record spans lines; then a file is one task."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    whole = records_span_lines(spark, path)
    reader = spark.read.schema(schema).option("header", True).option("multiLine", whole).option("mode", "FAILFAST").option("escape", '"').option("enforceSchema", True)
    return reader.option("emptyValue", "").option("nullValue", "\x00null").csv(path)


def read_csv_rows(spark: SparkSession, path: str, columns: list[str], parse_row: Callable[[dict[str, str | None]], tuple], schema: str) -> DataFrame:
    """Each record through ``parse_row``, which takes its texts by column and gives the values of ``schema``; what it raises fails the
    read.  A call for each row, in Arrow batches: for formats that expressions cannot parse."""
    from pyspark.sql.pandas.types import to_arrow_schema

    texts = _texts(spark, path, columns)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_row(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return texts.mapInArrow(run, schema)


def _parsed(text: Column, pattern: str, kind: str, name: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"bad {name}: "), F.coalesce(text, F.lit("null")))).cast(kind)
    value = text.try_cast(kind)
    return F.when(text.rlike(pattern) & value.isNotNull(), value).otherwise(bad)


def _note(text: Column) -> Column:
    return F.when(text != "", text)


def ingest_csv(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, note``: an id that is no integer and a short or long row fail; an empty note is null, an empty name stays."""
    t = _texts(spark, path, ["id", "name", "note"])
    return t.select(_parsed(F.col("id"), INTEGER_TEXT, "bigint", "id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), _note(F.col("note")).alias("note"))


def orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """``id, amount, placed_at, note`` with amounts of two decimals and times to the second."""
    t = _texts(spark, path, ["id", "amount", "placed_at", "note"])
    return t.select(
        _parsed(F.col("id"), INTEGER_TEXT, "bigint", "id").alias("id"),
        _parsed(F.col("amount"), AMOUNT_TEXT, "decimal(10,2)", "amount").alias("amount"),
        _parsed(F.col("placed_at"), TIME_TEXT, "timestamp_ntz", "placed_at").alias("placed_at"),
        _note(F.col("note")).alias("note"),
    )


def shipments_csv(spark: SparkSession, path: str) -> DataFrame:
    t = _texts(spark, path, ["order_id", "carrier", "shipped_at"])
    return t.select(
        _parsed(F.col("order_id"), INTEGER_TEXT, "bigint", "order_id").alias("order_id"),
        F.coalesce("carrier", F.lit("")).alias("carrier"),
        _parsed(F.col("shipped_at"), TIME_TEXT, "timestamp_ntz", "shipped_at").alias("shipped_at"),
    )


def first_bad_row(path: str, columns: int, integer_columns: tuple[int, ...] = (0,)) -> CsvError | None:
    """Looks for the first bad record of a local file, after a read has failed."""
    with open(path, encoding="utf-8", newline="") as f:
        reader = csv.reader(f, strict=True)
        row = -1
        try:
            next(reader, None)
            for row, record in enumerate(reader):
                if len(record) != columns:
                    return CsvError(path, f"{len(record)} fields instead of {columns}", row)
                for k in integer_columns:
                    if not re.fullmatch(r"[+-]?[0-9]+", record[k], re.ASCII) or not -(1 << 63) <= int(record[k]) < 1 << 63:
                        return CsvError(path, f"field {k} is no integer: {record[k]!r}", row)
        except csv.Error as e:
            return CsvError(path, str(e), row + 1)
    return None


def checked(df: DataFrame, path: str, columns: int) -> DataFrame:
    """``df`` after one pass over it; a failure is raised as ``CsvError`` with the row if the file is local."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception as e:
        try:
            found = first_bad_row(path.removeprefix("file://"), columns)
        except OSError:
            found = None
        raise found or CsvError(path, str(e).splitlines()[0]) from e
    return df


INGEST_ARROW = pa.schema([pa.field("id", pa.int64(), False), pa.field("name", pa.string(), False), pa.field("note", pa.string())])


def ingest_batches(path: str, size: int, direct: bool = True) -> Iterator[pa.RecordBatch]:
    """The ingest records of a local file as Arrow batches of ``size`` rows, filled column by column, or by way of rows.

    Both ways give the same values, nulls and errors; a consumer may stop at any batch, and an error comes after the
    batches before it.
    """
    if size <= 0:
        raise ValueError("a batch needs at least one row")

    def records() -> Iterator[tuple[int, str, str | None]]:
        with open(path, encoding="utf-8", newline="") as f:
            reader = csv.reader(f, strict=True)
            next(reader, None)
            try:
                for k, record in enumerate(reader):
                    if len(record) != 3 or not re.fullmatch(r"[+-]?[0-9]+", record[0], re.ASCII):
                        raise CsvError(path, "no ingest record", k)
                    yield int(record[0]), record[1], record[2] or None
            except csv.Error as e:
                raise CsvError(path, str(e)) from e

    source = records()
    while True:
        if direct:
            columns, failure = ([], [], []), None
            try:
                for record in islice(source, size):
                    for column, value in zip(columns, record):
                        column.append(value)
            except CsvError as e:
                failure = e
        else:
            rows, failure = [], None
            try:
                for record in islice(source, size):
                    rows.append(record)
            except CsvError as e:
                failure = e
            columns = tuple([r[k] for r in rows] for k in range(3))
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INGEST_ARROW)], schema=INGEST_ARROW)
        if failure:
            raise failure
        if len(columns[0]) < size:
            return


def select_column(path: str, column: int, headers: bool = True) -> Iterator[str]:
    """The lines of one column of a local file as CSV, the header line too unless there is none.

    A column out of range is told before anything is given; a malformed record fails where it stands.
    """
    if column < 0:
        raise ValueError(f"column {column} is out of range")

    def line(value: str) -> str:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL if value == "" else csv.QUOTE_MINIMAL, lineterminator="\n").writerow([value])
        return out.getvalue()

    def lines() -> Iterator[str]:
        with open(path, encoding="utf-8", newline="") as f:
            width = None
            for k, record in enumerate(csv.reader(f, strict=True)):
                width = len(record) if width is None else width
                if column >= width:
                    raise ValueError(f"column {column} is out of range: {width} columns")
                if len(record) != width:
                    raise CsvError(path, f"{len(record)} fields instead of {width}", k - headers)
                yield line(record[column])

    out = lines()
    first = next(out, None)
    return iter(()) if first is None else (x for part in ((first,), out) for x in part)


def select_column_df(spark: SparkSession, path: str, column: int, headers: bool = True) -> DataFrame:
    """The same as a distributed plan, for files of any size."""
    df = spark.read.option("header", headers).option("multiLine", True).option("mode", "FAILFAST").option("escape", '"').option("emptyValue", "").csv(path)
    if not 0 <= column < len(df.columns):
        raise ValueError(f"column {column} is out of range: {len(df.columns)} columns")
    name = df.columns[column]
    return df.select(F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name))


def split_records(raw: bytes, delimiter: bytes = b",") -> list[list[memoryview]] | None:
    """Naive rows and fields as views of ``raw`` without copies: no quoting, empty rows dropped; None if it is no UTF-8."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    view, rows, start = memoryview(raw), [], 0
    while start <= len(raw):
        end = raw.find(b"\n", start)
        end = len(raw) if end < 0 else end
        stop = end - 1 if end > start and raw[end - 1 : end] == b"\r" else end
        if stop > start:
            fields, at = [], start
            while (cut := raw.find(delimiter, at, stop)) >= 0:
                fields.append(view[at:cut])
                at = cut + len(delimiter)
            rows.append([*fields, view[at:stop]])
        start = end + 1
    return rows

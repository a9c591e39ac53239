"""Building blocks that keep plans safe for large and uneven data.

Nothing is broadcast here without a bound on its bytes: a side is measured first, a set of hot keys is bounded by
arithmetic (at most ``1 / share`` keys can hold ``share`` of the rows), and a Bloom filter is used in passes of bounded
size.  Salts come from measured shares of keys.  What a sample is drawn for decides only where rows are worked on, never
what comes out.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a measured side is broadcast.
BROADCAST_BYTES = 8 << 20
#: A key with this share of the rows is hot; a thousand keys can be at most.
HOT_SHARE = 0.001
#: Rows of the sample that hot keys are told from, about; a smaller table is read whole.
HOT_SAMPLE = 1_000_000
#: A Bloom filter is made in pieces of this many keys, each of ``BLOOM_BITS`` bits a key (5 MB).
PIECE_KEYS = 4_000_000
BLOOM_BITS = 10
#: Pieces that one pass over the probing rows holds (80 MB), as mapped files.
PASS_PIECES = 16
#: Pieces that one pass holds where files are not mounted: they go through the driver, which has each several times over.
DRIVER_PIECES = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster it is an error, for executors
    would not see such a folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessel-"))
    return sc.getCheckpointDir()


def mounted(folder: str) -> str | None:
    """A folder as a path of a mounted file system; None on any other."""
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    return path if path.startswith("/") else None


def shared_path(spark: SparkSession) -> str:
    """A new folder below ``shared_folder`` as a path of a mounted file system; other file systems are refused."""
    base = shared_folder(spark)
    path = mounted(base)
    if path is None:
        raise ValueError(f"{base} is not mounted: use a file system path for spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="tessel-", dir=os.makedirs(path, exist_ok=True) or path)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder; what is written there is removed when the session's driver ends."""
    out = f"{shared_folder(spark).rstrip('/')}/tessel-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_cut(df: DataFrame) -> bool:
    """Whether ``df`` is what ``cut`` gives, or columns and rows chosen from it, so that reading it twice costs little."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() in ("LogicalRDD", "LocalRelation", "Range")


def _width(field: T.StructField) -> Column:
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 32
    return F.lit(16)


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df``, about as they are in memory."""
    row = df.agg(F.count("*"), F.sum(sum((_width(f) for f in df.schema), F.lit(16)).cast("bigint"))).first()
    return row[0], row[1] or 0


def hot_hashes(df: DataFrame, on: list[str], share: float = HOT_SHARE, most: int | None = None) -> dict[int, float]:
    """Hash and share of rows of each non-null key that holds at least ``share`` of the rows, told from a sample."""
    rows = df.count()
    if not rows:
        return {}
    part = min(1.0, (most or HOT_SAMPLE) / rows)
    some = df.select(*on) if part == 1.0 else df.select(*on).sample(part, seed=1)
    least = max(2, math.ceil(rows * part * share))
    for c in on:
        some = some.where(F.col(c).isNotNull())
    found = some.groupBy(F.xxhash64(*on).alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r.h: r.n / (rows * part) for r in found.collect()}


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_bytes: int | None = None) -> DataFrame:
    """Equi-join of an uneven side with one that is unique in ``on``.  ``how`` is inner, left, left_semi or left_anti.

    ``small`` is computed once and measured; it is broadcast if it has at most ``most_bytes``.  Otherwise rows of hot keys
    are spread over as many salts as their measured share asks for, and rows with a null in ``on``, which match nothing,
    over all tasks.  A row's salt comes from the number of its task, so a task that runs again puts it in the same place.
    """
    small = small if is_cut(small) else cut(small)
    if size_of(small)[1] <= (BROADCAST_BYTES if most_bytes is None else most_bytes):
        return big.join(F.broadcast(small), on, how)
    parts = shuffle_parts(big.sparkSession)
    hot = hot_hashes(big, on)
    salts = max((math.ceil(s * parts) for s in hot.values()), default=1)
    some_null = sum((F.col(c).isNull().cast("int") for c in on), F.lit(0)) > 0
    is_hot = F.xxhash64(*on).isin(list(hot)) if hot else F.lit(False)
    left = big.withColumn("_salt", F.when(some_null, -1 - F.spark_partition_id()).when(is_hot, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key`` and ``n_rows`` of the non-null keys that hold at least ``share`` of the rows of ``df``.

    Told from a sample of about ``HOT_SAMPLE`` rows (all, of a smaller table), with ``n_rows`` scaled up; the counts are
    combined before the shuffle and at most ``1 / share`` keys come back.  An empty table and one with null keys only have
    no hot key.
    """
    spark = df.sparkSession
    total = df.count()
    schema = T.StructType([df.schema[key], T.StructField("n_rows", T.LongType())])
    if not total:
        return spark.createDataFrame([], schema)
    part = min(1.0, HOT_SAMPLE / total)
    some = df.select(key) if part == 1.0 else df.select(key).sample(part, seed=1)
    found = some.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, math.ceil(total * part * share)))
    return spark.createDataFrame([(r[0], round(r[1] / part)) for r in found.collect()], schema)


def _java(column: Column):
    from pyspark.sql.classic.column import _to_java_column

    return _to_java_column(column)


def _bloom(hashed: Column, keys: int) -> Column:
    """The aggregate that puts hashes into a filter made for ``keys`` of them."""
    from pyspark.sql import SparkSession
    from pyspark.sql.classic.column import Column as ClassicColumn
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    spark = SparkSession.active()
    n = max(keys, 1)
    args = [hashed, F.lit(n).cast("long"), F.lit(max(n * BLOOM_BITS, 1024)).cast("long")]
    return ClassicColumn(spark._jvm.PythonSQLUtils.internalFn("bloom_filter_agg", _to_seq(spark.sparkContext, args, _to_java_column)))


def _might_contain(spark: SparkSession, bloom: Column, hashed: Column) -> Column:
    """False where a filter proves that a hash was not put in, as for a missing filter; stays inside generated code."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = spark._jvm
    to = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(to.expression(_java(bloom)), to.expression(_java(hashed)))
    return F.coalesce(ClassicColumn(to.column(test)), F.lit(False))


def _bit_places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of the bits of hashes in a filter of ``bits`` bits, one array for each bit of a hash."""
    # mixed once more (splitmix64), for pieces are told apart by the same hash
    z = hashes.view(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    first, step = z & np.uint64(0xFFFFFFFF), (z >> np.uint64(32)) | np.uint64(1)
    for k in range(round(BLOOM_BITS * math.log(2))):
        yield (first + np.uint64(k) * step) % np.uint64(bits)


def _fill_piece(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the piece whose hashes the task has; a task that runs again writes the same file."""
        flags, piece = None, 0
        for batch in batches:
            if batch.num_rows:
                flags, piece = np.zeros(bits, bool) if flags is None else flags, batch.column(1)[0].as_py()
                for at in _bit_places(batch.column(0).to_numpy(), bits):
                    flags[at] = True
        if flags is not None:
            new = f"{folder}/{piece}-{uuid.uuid4().hex}"
            np.packbits(flags, bitorder="little").tofile(new)
            os.replace(new, f"{folder}/{piece}")
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32())], names=["piece"])

    return run


def _in_pieces(folder: str, bits: int, pieces: list[int]):
    maps: dict[int, np.ndarray] = {}

    def run(hashes: pa.Array, places: pa.Array) -> pa.Array:
        """Whether hashes may be in their pieces; those of other pieces are in none."""
        h, place = hashes.to_numpy(zero_copy_only=False), places.to_numpy(zero_copy_only=False)
        out = np.zeros(len(h), bool)
        for p in pieces:
            own = np.flatnonzero(place == p)
            if not len(own):
                continue
            if p not in maps:
                maps[p] = np.memmap(f"{folder}/{p}", np.uint8, "r")
            found = np.ones(len(own), np.uint8)
            for at in _bit_places(h[own], bits):
                found &= maps[p][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)
            out[own] = found == 1
        return pa.array(out)

    return run


@dataclass(frozen=True)
class BloomPass:
    """The pieces of a Bloom filter that are used at one time, and the keys that belong to them.

    ``own`` says of a key whether it belongs to the pass, ``may`` whether it may be in the filter; false proves that it is not.
    """

    own: Callable[[Column], Column]
    may: Callable[[Column], Column]


def bloom_passes(df: DataFrame, key: Column, keys: int, piece_keys: int = PIECE_KEYS, pass_pieces: int = PASS_PIECES) -> list[BloomPass]:
    """A Bloom filter over the non-null values of ``key``, of ``BLOOM_BITS`` bits for each of ``keys`` rows, for any number.

    One piece is broadcast as a scalar subquery, which no plan text holds.  Several are made by the hash of the key, on the
    executors, as files of the shared folder that tasks map into memory, so the driver holds none however many there are.
    Where that folder is not mounted, they are scalar subqueries, of which a pass has few.  Each pass has the pieces that fit
    its bound; ``in_passes`` runs one pass after the other.
    """
    spark = df.sparkSession
    pieces = max(1, -(-keys // piece_keys))
    some = df.where(key.isNotNull())
    if pieces == 1:
        bits = some.agg(_bloom(F.xxhash64(key), keys).alias("bits")).scalar()
        return [BloomPass(lambda k: F.lit(True), lambda k: _might_contain(spark, bits, F.xxhash64(k)))]
    folder = scratch(spark)
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(pieces)).cast("int")
    # the shuffle moves 12 bytes a key; each filter is then filled in one place, so no half-filled filters travel
    rows = some.select(F.xxhash64(key).alias("h"), place(key).alias("piece")).repartitionById(pieces, F.col("piece"))
    path = mounted(folder)
    if path is not None:
        os.makedirs(path)
        n_bits = -(-max(piece_keys * BLOOM_BITS, 1024) // 8) * 8
        filled = {r[0] for r in rows.mapInArrow(_fill_piece(path, n_bits), "piece int").collect()}

        def mapped(first: int, last: int) -> BloomPass:
            run = _in_pieces(path, n_bits, [p for p in range(first, last + 1) if p in filled])
            # so that the optimizer runs it nowhere else, as on the other side of a join
            test = F.arrow_udf(run, "boolean", F.ArrowUDFType.SCALAR).asNondeterministic()
            return BloomPass(lambda k: place(k).between(first, last), lambda k: test(F.xxhash64(k), place(k)))

        return [mapped(first, min(first + pass_pieces, pieces) - 1) for first in range(0, pieces, pass_pieces)]
    rows.groupBy("piece").agg(_bloom(F.col("h"), piece_keys).alias("bits")).write.partitionBy("piece").parquet(folder)
    kept = spark.read.schema("bits binary, piece int").parquet(folder)

    def of(first: int, last: int) -> BloomPass:
        def may(k: Column) -> Column:
            out = F.lit(False)
            for p in range(first, last + 1):
                bits = kept.where(F.col("piece") == p).agg(F.first("bits")).scalar()
                out = F.when(place(k) == p, _might_contain(spark, bits, F.xxhash64(k))).otherwise(out)
            return out

        return BloomPass(lambda k: place(k).between(first, last), may)

    few = min(pass_pieces, DRIVER_PIECES)
    return [of(first, min(first + few, pieces) - 1) for first in range(0, pieces, few)]


def in_passes(passes: list[BloomPass], make: Callable[[BloomPass], DataFrame]) -> DataFrame:
    """The union of what ``make`` gives for each pass.  Several passes run as jobs of their own, for tasks of one job would hold the
    filters of all; ``make`` should give few rows."""
    return reduce(DataFrame.unionByName, [make(p) if len(passes) == 1 else cut(make(p)) for p in passes])


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of both types compare by value."""
    if a == b:
        return a
    whole = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)):
            return T.DoubleType()
        p = [(x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (whole[x.simpleString()], 0) for x in (a, b)]
        scale = max(s for _, s in p)
        return T.DecimalType(min(38, max(d for d, _ in p) + scale), scale)
    return T.StringType()


def parts_for(rows: int, rows_per_part: int, least: int) -> int:
    """Number of parts so that each has about ``rows_per_part`` rows, ``least`` at least."""
    return max(least, int(Decimal(rows) / rows_per_part) + 1)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group: list[str], range_column: str, order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """Adds running sums, ``values`` from new name to column, in each group by ``range_column`` and then ``order``.

    A group may hold all rows: sums of ranges are made first, then each range is summed row by row on top of the sums of
    the ranges before.  Null values count as 0; neither a group column nor the range may be null.
    """
    before = Window.partitionBy(*group).orderBy(range_column).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, range_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    names = list(values)
    sums = df.groupBy(*group, range_column).agg(*(F.sum(values[n]).alias(f"_in_{k}") for k, n in enumerate(names)))
    sums = sums.select(*group, range_column, *(F.coalesce(F.sum(f"_in_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in range(len(names))))
    inner = df.withColumns({f"_within_{k}": F.coalesce(F.sum(values[n]).over(within), F.lit(0)) for k, n in enumerate(names)})
    out = sized_join(inner, sums, [*group, range_column])
    out = out.withColumns({n: F.col(f"_before_{k}") + F.col(f"_within_{k}") for k, n in enumerate(names)})
    return out.drop(*(f"_{w}_{k}" for w in ("before", "within") for k in range(len(names))))


def running_sum(df: DataFrame, group: list[str], range_column: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, group, range_column, order, {out: value})


def in_ranges(df: DataFrame, order: list[Column | str], rows_per_range: int = 100_000) -> DataFrame:
    """The rows with ``_range``, a whole number that does not fall along ``order``, and ``_tie``, which breaks ties.

    Spark's range partitioning makes the ranges, one for ``rows_per_range`` rows however many that makes.  Rows that are
    equal in ``order`` are split by ``_tie``, their place in ``df``, so a value that holds most rows has many ranges.
    ``df`` is kept first, so that a place means the same row in each job, and the ranges are kept, so that they are drawn once.
    """
    rows = df if is_cut(df) else cut(df)
    parts = parts_for(rows.count(), rows_per_range, 1)
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    if parts == 1:
        return rows.withColumn("_range", F.lit(0))
    return cut(rows.repartitionByRange(parts, *order, "_tie").withColumn("_range", F.spark_partition_id()))

"""Differences between two copies of a table, by content-defined chunking.

Both copies are reduced to three 64-bit hashes, of the key and two of the normalized row, put into buckets by key hash in
one shuffle and sorted by key hash.  A chunk ends where a rolling hash over the last keys meets a condition, so a missing
or extra row moves only the cuts next to it.  Chunks whose fingerprint both copies have are dropped; the rows of the
others show which keys may differ, and only rows of those keys are read in full and compared field by field, by their
true keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import HOT_SHARE, BloomPass, bloom_passes, common_type, cut, hot_keys, in_passes, parts_for, shuffle_parts, sized_join

#: A chunk has about this many keys.
CHUNK_KEYS = 16
#: Keys in the window of the rolling hash.
ROLL_KEYS = 3
#: Rows of a task, about, and buckets of a task, so many that tasks are even.
BUCKET_ROWS = 200_000
BUCKETS = 64


def row_key(parts: list[Column]) -> Column:
    """A key as text for the report: its parts with ``/`` between them, ``\\N`` for null."""
    return F.concat_ws("/", *(F.coalesce(p, F.lit("\\N")) for p in parts))


def _normal(df: DataFrame, other: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """``_h``, the hash of the key, and text that is equal where values are: ``_k0``, ... the parts of the key, ``_0``, ... the fields."""
    text = lambda c: F.col(c).cast(common_type(df.schema[c].dataType, other.schema[c].dataType)).cast("string")
    out = df.select(*(text(c).alias(f"_k{n}") for n, c in enumerate(key)), *(text(c).alias(f"_{n}") for n, c in enumerate(fields)))
    return out.select(F.xxhash64(*_tagged([f"_k{n}" for n in range(len(key))])).alias("_h"), "*")


def _tagged(columns: list[str]) -> list[Column]:
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


def _light(rows: DataFrame, side: int) -> DataFrame:
    """``_side``, ``_h`` and two hashes of the whole row."""
    tagged = _tagged([c for c in rows.columns if c != "_h"])
    return rows.select(F.lit(side).alias("_side"), "_h", F.xxhash64(*tagged).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(tagged)).alias("_h2"))


def chunked(sides: list[DataFrame], tasks: int, hot: list[int] = []) -> DataFrame:  # noqa: B006
    """``_b``, ``_side``, ``_h``, ``_h1``, ``_h2`` and ``_c``: the different rows of both copies with their bucket and chunk.

    Rows of the ``hot`` key hashes are reduced to different ones before they move, and spread over all buckets by their
    content.
    """
    rows = reduce(DataFrame.unionByName, [_light(x, n) for n, x in enumerate(sides)])
    is_hot = F.col("_h").isin(hot) if hot else F.lit(False)
    if hot:
        rows = rows.where(~is_hot).unionByName(rows.where(is_hot).distinct())
    place = F.when(is_hot, F.col("_h1")).otherwise(F.col("_h"))
    rows = rows.withColumn("_p", place).withColumn("_b", F.pmod(F.shiftrightunsigned("_p", 20), F.lit(BUCKETS * tasks)).cast("int")).repartition(tasks, "_b")
    order = Window.partitionBy("_b", "_side").orderBy("_p", "_h", "_h1", "_h2")
    row = F.struct("_h", "_h1", "_h2")
    rows = rows.withColumn("_new", F.coalesce(F.lag(row).over(order) != row, F.lit(True))).where("_new")
    rolling = F.bit_xor(F.shiftrightunsigned(F.xxhash64(F.lit("roll"), F.col("_p")), 7)).over(order.rowsBetween(1 - ROLL_KEYS, 0))
    first = F.coalesce(F.lag("_p").over(order) != F.col("_p"), F.lit(True))
    rows = rows.withColumn("_cut", (first & (F.pmod(rolling, F.lit(CHUNK_KEYS)) == 0)).cast("long"))
    return rows.select("_b", "_side", "_h", "_h1", "_h2", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"))


def prints(rows: DataFrame) -> DataFrame:
    """One row for each chunk: its fingerprint ``_p1``, ``_p2``, ``_n`` and its rows."""
    return rows.groupBy("_b", "_side", "_c").agg(
        F.bit_xor("_h1").alias("_p1"), F.bit_xor("_h2").alias("_p2"), F.count("*").alias("_n"), F.collect_list(F.struct("_h", "_h1", "_h2")).alias("_rows")
    )


def differing(sides: list[DataFrame], tasks: int, hot: list[int] = []) -> DataFrame:  # noqa: B006
    """``_h`` of the keys that are not proved to have the same different rows on both sides; the copies meet in the buckets of one shuffle."""
    same = Window.partitionBy("_b", "_p1", "_p2", "_n")
    chunks = prints(chunked(sides, tasks, hot)).withColumns({"_lo": F.min("_side").over(same), "_hi": F.max("_side").over(same)})
    # the anti-join of fingerprints: chunks that stand on one side only
    rows = chunks.where(F.col("_lo") == F.col("_hi")).select("_b", "_side", F.explode("_rows").alias("_r")).select("_b", "_side", "_r.*")
    # a row that stands in unmatched chunks of both sides is no difference
    single = rows.groupBy("_b", "_h", "_h1", "_h2").agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return single.where(F.col("_lo") == F.col("_hi")).select("_h").distinct()


def differences(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], dataset: str) -> DataFrame:
    """``dataset``, ``row_key``, ``difference``: ``only_left``, ``only_right`` or the name of a field that differs.

    Numbers compare by value, texts exactly, null equals only null, in keys as in fields; repeated rows count once.  Keys
    are compared part by part; a null part of a key is written ``\\N`` in ``row_key``.  If a key has several different rows
    on a side, a field differs when its set of values does.  Columns that are neither key nor field are not read; two
    empty copies have no difference.
    """
    sides = [_normal(left, right, key, fields), _normal(right, left, key, fields)]
    n_rows = max(left.count(), right.count())
    hot = sorted({r[0] for x in sides for r in hot_keys(x, "_h", HOT_SHARE).collect()}) if n_rows > BUCKET_ROWS else []
    keys = cut(differing(sides, parts_for(2 * n_rows, BUCKET_ROWS, shuffle_parts(left.sparkSession)), hot))
    key_hash = F.col("_h")

    def unlike(p: BloomPass) -> DataFrame:
        """The full rows of both sides whose keys may differ and belong to a pass."""
        return reduce(
            DataFrame.unionByName,
            [sized_join(x.where(p.own(key_hash) & p.may(key_hash)), keys.where(p.own(key_hash)), ["_h"], "left_semi").withColumn("_side", F.lit(n)) for n, x in enumerate(sides)],
        )

    found = in_passes(bloom_passes(keys, key_hash, keys.count()), unlike)
    parts = [f"_k{n}" for n in range(len(key))]
    cells = [F.struct(F.lit(None).cast("string").alias("f"), F.lit(None).cast("string").alias("v"))]
    cells += [F.struct(F.lit(f).alias("f"), F.col(f"_{n}").alias("v")) for n, f in enumerate(fields)]
    values = found.select(*parts, "_side", F.explode(F.array(*cells)).alias("_x"))
    values = values.groupBy(*parts, F.col("_x.f").alias("_f"), F.col("_x.v").alias("_v")).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    # the row without field tells which sides have the key at all
    per_key = values.groupBy(*parts).agg(
        F.max(F.when(F.col("_f").isNull(), F.col("_lo") * 2 + F.col("_hi"))).alias("_where"),
        F.collect_set(F.when(F.col("_f").isNotNull() & (F.col("_lo") == F.col("_hi")), F.col("_f"))).alias("_fields"),
    )
    what = F.when(F.col("_where") == 0, F.array(F.lit("only_left"))).when(F.col("_where") == 3, F.array(F.lit("only_right"))).otherwise(F.col("_fields"))
    return per_key.select(F.lit(dataset).alias("dataset"), row_key([F.col(p) for p in parts]).alias("row_key"), F.explode(what).alias("difference"))


def all_differences(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

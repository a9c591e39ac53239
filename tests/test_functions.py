import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessel import functions as X
from tessel.plans import optimized
from tessel.sources.csv import AMOUNT_TEXT


def one(spark, column, rows=((1,),), schema="x int"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_days_since_epoch(spark):
    micros = [0, -1, -86_400_000_000, 86_400_000_000 - 1, -(1 << 63), (1 << 63) - 1, None]
    df = spark.createDataFrame([(m,) for m in micros], "m bigint").select(X.days_since_epoch(F.timestamp_micros("m")).alias("d"))
    assert [r.d for r in df.collect()] == [0, -1, -1, 0, -106751992, 106751991, None]
    assert "20456" in optimized(spark.range(1).select(X.days_since_epoch(F.expr("timestamp_ntz'2026-01-03 08:15:00'"))))
    with pytest.raises(TypeError):
        X.days_since_epoch("id", spark.range(1))


def test_registered_functions_fold_and_agree(spark):
    X.register_functions(spark)
    assert "20456" in optimized(spark.sql("select days_since_epoch(timestamp_ntz'2026-01-03 00:00:00')"))
    assert spark.sql("select amount_range(v) from values (1.50), (3.25), (null) t(v)").first()[0] == Decimal("1.75")
    assert spark.sql("select amount_range(v) from values (cast(null as decimal(10,2))) t(v)").first()[0] is None


def test_wrapping_add(spark):
    xs = [0, 1, -1, 2**31 - 1, -(2**31), 12345]
    for k in (0, 7, -7, 2**31 - 1, -(2**31)):
        got = one(spark, X.wrapping_add("x", k), [(x,) for x in xs])
        assert got == [(x + k + 2**31) % 2**32 - 2**31 for x in xs]
    with pytest.raises(Exception, match="null value"):
        one(spark, X.wrapping_add("x", 1), [(None,)])
    for bad in (F.lit(1), "1", True):
        with pytest.raises(TypeError):
            X.wrapping_add("x", bad)
    with pytest.raises(TypeError):
        X.wrapping_add(5, 1)
    with pytest.raises(TypeError):
        X.wrapping_add("id", 1, spark.range(1))


@pytest.mark.parametrize("text", ["0", "1.5", "-2.25", ".5", "7.", "+3"])
def test_strict_decimal_takes(spark, text):
    assert one(spark, X.strict_decimal("x"), [(text,)], "x string") == [Decimal(text).quantize(Decimal("0.01"))]


@pytest.mark.parametrize("text", ["4e7", "", ".", "-", "+", " 1.5", "1.5 ", "1.5\n", "١.00"])
def test_strict_decimal_refuses(spark, text):
    with pytest.raises(Exception, match="not a decimal"):
        one(spark, X.strict_decimal("x"), [(text,)], "x string")


def amount_by_hand(text):
    """The stated grammar, sign by sign: an optional sign, ASCII digits, a point, two ASCII digits."""
    rest = text[1:] if text[:1] in ("+", "-") else text
    whole, point, cents = rest.partition(".")
    return point == "." and len(cents) == 2 and bool(whole) and all(c in "0123456789" for c in whole + cents)


def test_amount_text_is_its_grammar(spark):
    dice = random.Random(12)
    signs = ["", "", "+", "-", "--", " "]
    digits = ["0", "7", "42", "00", "", "３", "e", " "]
    texts = sorted({dice.choice(signs) + dice.choice(digits) + dice.choice(digits) + dice.choice([".", ".", "", ","]) + dice.choice(digits) + dice.choice(["", "", "5", "\n", "0"]) for _ in range(3000)})
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.col("x").rlike(AMOUNT_TEXT).alias("ok")).collect()
    want = {t: amount_by_hand(t) for t in texts}
    assert {r.x: r.ok for r in got} == want and 20 < sum(want.values()) < len(want) - 20


@pytest.mark.parametrize("text", ["-0.01", "-1.23", "+1.23", "-0.00", "0001.23", "99999999.99", "-99999999.99"])
def test_amount_text_takes(spark, text):
    assert one(spark, F.when(F.col("x").rlike(AMOUNT_TEXT), F.col("x").cast("decimal(10,2)")), [(text,)], "x string") == [Decimal(text)]


def test_guarded_branch_is_lazy(spark):
    rows = [("12",), ("x",)]
    safe = F.when(F.col("x") == "x", F.lit(-1).cast("bigint")).otherwise(F.col("x").cast("bigint"))
    assert one(spark, safe, rows, "x string") == [12, -1]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, F.col("x").cast("bigint"), rows, "x string")


def test_amount_range_in_parts(spark):
    df = spark.createDataFrame([(Decimal("-99999999.99"),), (None,), (Decimal("99999999.99"),), (Decimal("1.00"),)], "a decimal(10,2)")
    for parts in itertools.chain(([1, 1, 1, 1],), itertools.permutations([0, 1, 2])):
        chosen = F.pmod(F.monotonically_increasing_id() * 7, F.lit(len(set(parts))))
        assert X.amount_range_parts(df, "a", chosen).first()[0] == Decimal("199999999.98")
    none = df.where("a is null")
    assert none.agg(X.amount_range("a")).first()[0] is None and df.limit(0).agg(X.amount_range("a")).first()[0] is None
    assert df.where("a = 1").agg(X.amount_range("a")).first()[0] == 0


def test_lookups(spark):
    async def call(k):
        return X.lookups.REGION_MULTIPLIERS.get(k, 1.0)

    ids = [1, 2, 4, 5, 6, 8, None]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    want = [1.5, 1.0, 1.5, 0.8, 0.8, 1.5, None]
    assert [r[0] for r in df.select(X.region_multiplier("id")).collect()] == want
    assert [r[0] for r in df.select(X.async_lookup(call)("id")).collect()] == want
    with pytest.raises(TypeError):
        X.async_lookup(lambda k: 1.0)


def test_volatile_calls_are_not_shared(spark):
    n = spark.sparkContext.accumulator(0)

    async def call(k):
        n.add(1)
        return 1.0

    f = X.async_lookup(call)
    df = spark.createDataFrame([(1,), (1,)], "id bigint").coalesce(1).select(f("id").alias("a"), f("id").alias("b"))
    df.collect()
    df.collect()
    assert n.value == 8


def test_digest(spark):
    rows = [(1, "a", None), (1, "a", ""), (2, None, "b"), (2, None, "b")]
    df = spark.createDataFrame(rows, "id bigint, name string, note string")
    of = lambda d: d.agg(X.multiset_digest("id", "name", "note")).first()[0]
    whole = of(df)
    assert whole == of(df.repartition(3).orderBy(F.desc("id"))) and len(whole) == 16
    assert whole != of(df.dropDuplicates()) and of(df.limit(1)) != of(df.limit(2))
    assert of(df.limit(0)) == "0" * 16
    shifted = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string").select(X.row_digest("x", "y").alias("h")).collect()
    assert shifted[0].h != shifted[1].h


def test_kernels(spark):
    df = spark.createDataFrame([(k, [float(k + i) for i in range(k % 3 + 1)], float(k), None) for k in range(6)], "r int, xs array<double>, a double, b double")
    assert [r.xs for r in df.select(X.add_one_list("xs").alias("xs")).collect()] == [[k + i + 1.0 for i in range(k % 3 + 1)] for k in range(6)]
    flat, rows = X.add_one_flat(df, ["a", "b"]).collect(), X.add_one_row_major(df, ["a", "b"]).collect()
    assert flat == rows and flat[2].a == 3.0 and flat[2].b is None
    deep = spark.createDataFrame([([([([1.0, 2.0],), ([],)],), ([],)],)], "w array<struct<items:array<struct<values:array<double>>>>>")
    assert deep.select(X.checksum_deep(X.add_one_deep("w"))).first()[0] == 5.0
    runs = spark.createDataFrame([("a", 0, 2), ("b", 2, 0), ("c", 2, 3)], "v string, start int, length int")
    assert [(r.v, r.position) for r in X.decode_runs(runs).orderBy("position").collect()] == [("a", 0), ("a", 1), ("c", 2), ("c", 3), ("c", 4)]
    codes, words = spark.createDataFrame([(0,), (1,), (None,), (9,)], "code int"), spark.createDataFrame([(0, "x"), (1, "y")], "code int, v string")
    assert sorted((r.code is None, r.code, r.v) for r in X.decode_dictionary(codes, words).where("code is not null").collect()) == [(False, 0, "x"), (False, 1, "y"), (False, 9, None)]
    assert X.decode_dictionary(codes, words).count() == 4


def test_small_helpers(spark):
    df = spark.createDataFrame([("two words", [1, 2, 3], 1.0, 1.0 + 1e-10), ("one", [], 1.0, 1.1), (None, None, None, 1.0)], "s string, xs array<int>, a double, b double")
    got = df.select(X.first_word("s"), X.number_prefix("xs", 2), X.byte_length("s"), X.append_suffix("s", "!"), X.approx_equal("a", "b")).collect()
    assert [tuple(r) for r in got] == [("two", [1, 2], 9, "two words!", True), ("one", [], 3, "one!", False), (None, None, None, None, None)]

import datetime as dt
import json
import random
import re
import statistics
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessel import scale
from tessel.quality import differences, drift, hotkeys, orphans, parsing, profile, queries

T0 = dt.datetime(2025, 3, 1)


def at(days):
    return None if days is None else T0 + dt.timedelta(days=days)


# --- scale helpers


def test_sized_join_beyond_its_bound(spark):
    big = spark.createDataFrame([(k % 3 or None, k) for k in range(60)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (5, "e")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = Counter(map(tuple, big.join(small, "k", how).collect()))
        for most in (10_000, 1):
            assert Counter(map(tuple, scale.sized_join(big, small, ["k"], how, most_bytes=most).collect())) == want


def test_hot_and_null_keys_are_spread(spark):
    big = spark.range(0, 9000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    small = spark.range(9000).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scale.sized_join(big, small, ["k"], "left", most_bytes=1)
        rows = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.count() == 9000 and out.where("w is null").count() == 3000 == big.where("k is null").count()
    assert max(r.n for r in rows) < 5000, rows


def test_a_cut_is_known(spark):
    df = spark.range(5)
    kept = scale.cut(df.groupBy("id").count())
    assert scale.is_cut(kept.select("id")) and not scale.is_cut(kept.groupBy("id").count()) and scale.size_of(kept)[0] == 5


def test_hot_keys(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(None,)] * 30 + [(k,) for k in range(2, 22)], "k bigint")
    assert [tuple(r) for r in scale.hot_keys(df, "k", 0.1).collect()] == [(1, 50)]
    assert scale.hot_keys(df.limit(0), "k", 0.1).collect() == scale.hot_keys(df.where("k is null"), "k", 0.1).collect() == []


def test_bloom_has_no_false_negative(spark):
    keys, key = spark.range(0, 3000, 3), F.col("id")
    for piece, of_pass, n_passes in ((10_000, 16, 1), (300, 2, 2), (90, 16, 1), (30, 4, 9)):
        passes = scale.bloom_passes(keys, key, 1000, piece, of_pass)
        assert len(passes) == n_passes
        found = scale.in_passes(passes, lambda p: spark.range(6000).where(p.own(key)).withColumn("may", p.may(key)))
        assert found.count() == 6000 == found.select("id").distinct().count()
        assert found.where("may and id % 3 = 0 and id < 3000").count() == 1000
        # ten bits a key, in however many pieces: nearly all others are proved to be absent
        assert found.where("not may").count() >= 0.98 * 5000
    (none,) = scale.bloom_passes(keys.limit(0), key, 0)
    assert spark.range(5).where(~none.may(key)).count() == 5


@pytest.mark.parametrize("is_mounted", [True, False])
def test_bloom_pieces_do_not_go_through_the_driver(spark, monkeypatch, is_mounted):
    if not is_mounted:
        monkeypatch.setattr(scale, "mounted", lambda folder: None)
    key = F.col("id")
    passes = scale.bloom_passes(spark.range(0, 3000, 3), key, 1000, 90, 16)
    found = [spark.range(6000).where(p.own(key)).withColumn("may", p.may(key)) for p in passes]
    sent = [len(set(re.findall(r"subquery#\d+", df._jdf.queryExecution().optimizedPlan().toString()))) for df in found]
    # pieces are read from files; without mounted files, few are in one plan
    assert sent == ([0] if is_mounted else [2] * 6)
    both = scale.in_passes(passes, lambda p: spark.range(6000).where(p.own(key)).withColumn("may", p.may(key)))
    assert both.where("may and id % 3 = 0 and id < 3000").count() == 1000 and both.where("not may").count() >= 0.98 * 5000
    assert both.count() == 6000


@pytest.mark.parametrize("rows_per_range", [4, 1000])
def test_running_sum(spark, rows_per_range):
    rows = [(k % 2, float(k * 7 % 23) if k % 6 else None, k, k if k % 5 else None) for k in range(50)]
    df = scale.in_ranges(spark.createDataFrame(rows, "g int, x double, i int, v bigint"), [F.asc_nulls_last("x"), "i"], rows_per_range).withColumnRenamed("_range", "r")
    out = {r.i: r.s for r in scale.running_sum(df, ["g"], "r", [F.asc_nulls_last("x"), "i"], "v", "s").collect()}
    for g in (0, 1):
        total = 0
        for _, _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1], r[2])):
            total += v or 0
            assert out[i] == total


def test_ranges_split_ties(spark):
    df = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 5 < 2, 7.0).when(F.col("id") % 5 == 2, None).otherwise(F.rand(3)).alias("x"), F.lit(1).alias("same"))
    sizes = [r.n for r in scale.in_ranges(df, [F.asc_nulls_last("x")], 5_000).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100_000 and len(sizes) == 21 and max(sizes) < 10_000


# --- problem 1

NAMES = {"": True, "Ada": False, "Zoë O'Neil-B.": False, " Ada": True, "Ada ": True, "A  B": True, "A 1": True, "雨天": False, "A .b": True, "A b.": False, "a\nb": True, "x" * 50_000: False, "1a": True}
NOTES = {"": True, " ": True, "a": False, "a\nb": False, "a\tb": True, "\na": True, "a\xa0": True, "a�b": True, "雨天 1": False, "a\x1b": True, "　a": True, "ok " * 20_000 + "k": False}


def test_declared_patterns(spark):
    for texts, breaks in ((NAMES, profile.name_breaks), (NOTES, profile.note_breaks)):
        df = spark.createDataFrame([(t,) for t in texts], "v string")
        shape = df.select("v", profile.exact_shape(F.col("v")).alias("e1"))
        got = {r.v: (r.a, r.b) for r in shape.select("v", breaks(F.col("v")).alias("a"), breaks(F.col("e1")).alias("b")).collect()}
        assert {t: (x, x) for t, x in texts.items()} == got


ORDERS = "load_no int, note string, amount decimal(10,2), level string, value string, n string"


def order_rows(seed=1, loads=6, rows=60):
    dice = random.Random(seed)
    pool = [*(k for k in NOTES if len(k) < 100), None, None, *(f"order {k} late" for k in range(30))]
    out = [(load if load else None, dice.choice(pool), None if dice.random() < 0.1 else Decimal(dice.randrange(-100, 3_000_000)) / 100, "x", "y", "z") for load in range(loads) for _ in range(rows)]
    return out + out[:40] + [(77, None, None, "x", "y", "z")]


RULES = [profile.ColumnRule("note", breaks=profile.note_breaks), profile.ColumnRule("amount", outside=profile.amount_outside)]


def test_profile_equals_brute_force(spark):
    rows = order_rows()
    got = {(r.load_no, r.column_name): r for r in profile.profile(spark.createDataFrame(rows, ORDERS), "t", RULES).collect()}
    loads = {r[0] for r in rows}
    assert set(got) == {(x, c) for x in loads for c in ("note", "amount")}
    for load in loads:
        for c, k in (("note", 1), ("amount", 2)):
            r, values = got[load, c], [x[k] for x in rows if x[0] == load]
            some = [v for v in values if v is not None]
            assert (r.n_rows, r.n_values, r.n_distinct) == (len(values), len(some), len(set(some)))
            assert r.null_share == (len(values) - len(some)) / len(values)
            if not some:
                assert r.level is r.pattern_share is r.range_share is r.distinct_share is r.coverage is None
                continue
            assert r.level == pytest.approx(statistics.median(len(v) if c == "note" else float(v) for v in some), abs=1e-9)
            if c == "note":
                assert r.pattern_share == sum(NOTES.get(v, False) for v in some) / len(some) and r.range_share is None
            else:
                assert r.range_share == sum(v < Decimal("0.01") or v > 20000 for v in some) / len(some) and r.pattern_share is None
            assert 0 <= r.coverage <= 1
    assert profile.profile(spark.createDataFrame([], ORDERS), "t", RULES).collect() == []


PATTERNS = {"note": profile.note_breaks, "name": profile.name_breaks}


def test_expressions_are_run_as_regular_expressions(spark, sf):
    df = spark.read.parquet(f"{sf}/headers.parquet").where("name is not null")
    cells = profile.value_counts(df, ["name", "note"])
    own = profile.expressions(cells, PATTERNS)
    values = [r.value for r in cells.where("column_name = 'name' and value is not null").select("value").distinct().collect()]
    assert 3 < len(own["name"]) <= 100 and sum(e.n_values for e in own["name"]) <= len(values)
    regex = pytest.importorskip("regex")
    first = Counter()
    for v in values:
        k = next((k for k, e in enumerate(own["name"]) if regex.fullmatch(e.regex, v)), -1)
        first[k] += 1
        broken = regex.fullmatch(r"\p{L}[\p{L}'.-]*( \p{L}[\p{L}'.-]*)*", v) is None
        if k >= 0 and own["name"][k].verdict != "mixed":
            assert broken == (own["name"][k].verdict == "outside"), v
    got = {r["_e"]: r.n for r in cells.where("column_name = 'name' and value is not null").select("column_name", "value").distinct().withColumn("_e", profile.matched(own)).groupBy("_e").agg(F.count("*").alias("n")).collect()}
    assert got == first
    # what induced an expression is also what it matches
    assert sum(n for k, n in first.items() if k >= 0) >= sum(e.n_values for e in own["name"])


def test_expressions_judge_most_values(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/headers.parquet")
    rules = [profile.ColumnRule("name", breaks=profile.name_breaks)]
    shares = lambda rows: {(r.load_no, r.pattern_share) for r in rows}
    real = profile.profile(df, "headers", rules).collect()
    assert sum(r.n_checked for r in real) < 0.25 * sum(r.n_values for r in real)
    dummy = profile.Expression("headers\x00name", 4, "(?s:.)+", 1)
    monkeypatch.setattr(profile, "expressions", lambda cells, breaks=None: {dummy.column: [dummy]})
    mixed = profile.profile(df, "headers", rules).collect()
    assert shares(mixed) == shares(real) and sum(r.n_checked for r in mixed) == sum(r.n_values for r in mixed)
    # an expression is believed: a wrong verdict shows in the result
    wrong = profile.Expression(dummy.column, 1, "(?s:.)+", 1, "outside")
    monkeypatch.setattr(profile, "expressions", lambda cells, breaks=None: {dummy.column: [wrong]})
    assert all(r.pattern_share == 1 for r in profile.profile(df, "headers", rules).collect() if r.n_values)


def test_verdicts(spark):
    own = [("name", 2, "Ab b", 1), ("name", 3, " w", 1), ("name", 4, "w", 1), ("name", 4, " w", 1), ("other", 1, "a", 1), ("note", 4, "!w8", 1), ("note", 1, "", 1)]
    got = profile._verdicts(spark, own, PATTERNS)
    assert [got[o[:3]] for o in own] == ["inside", "outside", "inside", "mixed", "mixed", "inside", "outside"]


def test_many_shapes_share_the_shorter_expression(spark):
    dice = random.Random(9)
    word = lambda n: "".join(dice.choice("abcdefgh") for _ in range(n))
    values = [(1, f"{word(dice.randrange(2, 14))} {dice.randrange(10 ** dice.randrange(2, 9)):02d}") for _ in range(400)] + [(1, "#" * 40)]
    (own,) = profile.expressions(profile.value_counts(spark.createDataFrame(values, "load_no int, note string"), ["note"])).values()
    best = max(own, key=lambda e: e.n_values)
    assert best.level > 1 and best.n_values >= 300 and best.regex in (r"[a-z]{2,}\ [0-9]{2,}", r"\p{L}+\ [0-9]+")


def test_coverage_changes(spark):
    df = spark.createDataFrame([(load, f"{load:03d}-{k:02d}" if load != 5 else "ab" * (k % 9 + 1)) for load in range(8) for k in range(20)], "load_no int, code string")
    shares = profile.expression_shares([(df, "t", ["code"])])
    assert shares.groupBy("load_no").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    got = {(r.load_no, r.expression): r.share for r in profile.coverage_changes(shares).collect()}
    assert {load for load, _ in got} == {5} and got[5, r"[0-9][0-9][0-9]\-[0-9][0-9]"] == 0.0


def test_departures(spark):
    rows = [("t", "c", load, 0.5 if load == 3 else 0.1, 0.2 if load == 4 else 0.9, None, None, 16.1 if load == 5 else 10.0) for load in range(9)]
    df = spark.createDataFrame(rows, "table_name string, column_name string, load_no int, null_share double, distinct_share double, pattern_share double, range_share double, level double")
    got = {(r.load_no, r.measure) for r in profile.departures(df, queries.MEASURES).collect()}
    assert got == {(3, "null_share"), (4, "distinct_share"), (5, "level")}


# --- problem 2


def orphan_tables(spark, refs, parents):
    r = spark.createDataFrame(refs, "order_id bigint, shipment_id bigint, loaded_at timestamp_ntz, shipped_at timestamp_ntz").withColumns({"kind": F.lit(1), "_key": F.lit("k"), "deleted_at": F.lit(0)})
    p = spark.createDataFrame(parents, "id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz").withColumns({"order_id": F.lit(1), "_first": F.lit(2)})
    return r, p


def test_orphans_equal_brute_force(spark):
    dice = random.Random(2)
    day = lambda: None if dice.random() < 0.1 else at(dice.randrange(20))
    parents = [(dice.randrange(40) if dice.random() < 0.97 else None, day(), day() if dice.random() < 0.3 else None) for _ in range(60)]
    refs = [(7 if k % 3 == 0 else dice.choice([None, *range(60)]), k, day(), day()) for k in range(900)]
    refs += refs[:50]
    want = set()
    for o, s, seen, _ in refs:
        if o is None:
            continue
        own = [p for p in parents if p[0] == o]
        first = min((p[1] for p in own if p[1]), default=None)
        gone = min((p[2] for p in own if p[2]), default=None)
        if not own:
            want.add((s, "missing"))
        elif first and seen and first > seen:
            want.add((s, "late"))
        elif gone and seen and gone <= seen:
            want.add((s, "deleted"))
    r, p = orphan_tables(spark, refs, parents)
    got = [tuple(x) for x in orphans.orphan_references(r, p).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = orphans.orphan_report(orphans.orphan_references(r, p, keep=("shipment_id", "shipped_at")), "shipments")
    assert report.agg(F.sum("n_references")).first()[0] == len(want)


def test_orphans_in_several_passes(spark, monkeypatch):
    dice = random.Random(5)
    parents = [(k, at(k % 9), at(15) if k % 7 == 0 else None) for k in range(0, 900, 3)]
    refs = [(dice.choice([6, dice.randrange(900)]), k, at(dice.randrange(20)), at(0)) for k in range(3000)]
    r, p = orphan_tables(spark, refs, parents)
    want = Counter(map(tuple, orphans.orphan_references(r, p).collect()))
    monkeypatch.setattr(scale.bloom_passes, "__defaults__", (40, 3))
    assert Counter(map(tuple, orphans.orphan_references(r, p).collect())) == want and len(want) > 1500


def test_orphans_of_empty_tables(spark):
    r, p = orphan_tables(spark, [(1, 1, at(0), at(0)), (None, 2, at(0), None)], [(1, at(0), None)])
    assert [tuple(x) for x in orphans.orphan_references(r, p.limit(0)).collect()] == [(1, "missing")]
    assert orphans.orphan_references(r.limit(0), p).collect() == [] == orphans.orphan_references(r, p).collect()


# --- problem 3

RECORDS = [
    ("1,Ada", None), ('2,"a ""b"" c, d\ne"', None), ("3", "column_count"), ("4,a,b", "column_count"), ('5,"a', "quoting"), ('6,a"b', "quoting"), ('7,"a"b', "quoting"), ('8, "a"', "quoting"), ('9,"a" ', "quoting"),
    ("", "column_count"), (None, "quoting"), ("x,a", "id"), (" 1,a", "id"), ("1 ,a", "id"), ("+1,a", "id"), ("-0,", None), ("9223372036854775807,a", None), ("9223372036854775808,a", "id"), ("-9223372036854775808,a", None),
    ("١,a", "id"), (",a", "id"), ('"5",a', None), ('"5""",a', "id"), ("00000000000000000000000012,a", None), ('1,"' + '""' * 30_000 + '"', None), ("1," + "x" * 200_000, None), ("1,\x01a\x02b", None), ('"",""', "id"), ('1,""', None), ("1\n,a", "id"),
]
ORDER_RECORDS = [
    ("1,1,2025-01-01T00:00:00,", None), ("1,12345678.99,2025-01-01T00:00:00.123456,n", None), ("1,123456789,2025-01-01T00:00:00,n", "amount"), ("1,1.,2025-01-01T00:00:00,n", "amount"), ("1,1.234,2025-01-01T00:00:00,n", "amount"),
    ("1,+1,2025-01-01T00:00:00,n", "amount"), ("1,-1.5,2024-02-29T23:59:59,n", None), ("1,1,2025-02-29T00:00:00,n", "placed_at"), ("1,1,2025-01-01 00:00:00,n", "placed_at"), ("1,1,2025-01-01T24:00:00,n", "placed_at"), ("1,1,2025-01-01T00:00:60,n", "placed_at"),
    ("1,1,2025-01-01T00:00:00.,n", "placed_at"), ("1,1,2025-01-01T00:00:00.1234567,n", "placed_at"), ("1,1,2025-01-01T00:00:00Z,n", "placed_at"), ("1,,2025-01-01T00:00:00,n", "amount"), ("1,1,,n", "placed_at"), ("x,y,z,n", "id"), ("1,y,z,n", "amount"), ("1,2,3", "column_count"),
]


def malformed(spark):
    rows = [(1000, 1, 1, "id,name"), (1001, 2, 1, "id,amount,placed_at,note")]
    rows += [(k, 1, k + 2, raw) for k, (raw, _) in enumerate(RECORDS)] + [(100 + k, 2, 90 - k, raw) for k, (raw, _) in enumerate(ORDER_RECORDS)] + [(500, 3, 2, "1,a")]
    dice = random.Random(4)
    dice.shuffle(rows)
    return spark.createDataFrame(rows, "record_id bigint, file_no bigint, line_no int, raw string").withColumns({"reason": F.lit(1), "_column": F.lit(2), "id": F.lit(3)})


@pytest.mark.parametrize("rows", [None, 0])
def test_parsing(spark, monkeypatch, rows):
    if rows is not None:
        monkeypatch.setattr(scale, "BROADCAST_BYTES", rows)
    want = {k: r for k, (_, r) in enumerate(RECORDS)} | {100 + k: r for k, (_, r) in enumerate(ORDER_RECORDS)} | {500: "column_count"}
    parsed = parsing.parse_records(malformed(spark))
    assert {r.record_id: r.reason for r in parsing.failures(parsed).collect()} == {k: r for k, r in want.items() if r}
    loaded = {r.record_id: r for r in parsing.loaded(parsed).collect()}
    assert set(loaded) == {k for k, r in want.items() if r is None}
    assert loaded[1].name == 'a "b" c, d\ne' and loaded[24].name == '"' * 30_000 and loaded[26].name == "\x01a\x02b" and loaded[15].name == "" and loaded[15].id == 0
    assert (loaded[101].amount, loaded[101].placed_at.microsecond, loaded[100].note, loaded[101].name) == (Decimal("12345678.99"), 123456, None, None)
    assert parsing.failure_report(parsed).agg(F.sum("n_records")).first()[0] == len(want)


def test_parsing_an_empty_table(spark):
    assert parsing.parse_records(malformed(spark).limit(0)).collect() == []


# --- problem 4

LINES = "file_no bigint, stream string, written_at timestamp_ntz, line_no int, body string"


def test_name_meaning(spark):
    same = [("input_size", "inputSize"), ("input_size", "size_of_input"), ("input_e_tag", "inputETag"), ("input_e_tag", "input-e-tag"), ("row_count", "n_rows"), ("rows", "Row_Count"), ("schema_version", "schema_ver"), ("run_id", "publishing_run")]
    assert all(drift.same_meaning(a, b) for a, b in same) and not drift.same_meaning("attempt", "queue_wait_ms")
    # names that stand side by side differ, and so do the words in which they differ
    files = [(k, f, 1, 1) for k in range(10) for f in (("input_key", "output_key", "input_tag") if k % 2 else ("input_path", "zone"))]
    fields = spark.createDataFrame(files, "file_no bigint, field string, n_lines bigint, types int")
    learned = drift.learn(fields, drift.names_by_use(fields))
    assert learned.exclusive == {frozenset(("input", "output")), frozenset(("key", "tag"))}
    assert not drift.same_meaning("input_e_tag", "output_e_tag", learned) and drift.same_meaning("input_key", "input_path", learned)
    # words that take each other's place in several files mean the same
    renames = spark.createDataFrame([(1, "input_key", "source_key"), (2, "input_key", "source_key"), (3, "output_key", "input_key"), (4, "output_key", "input_key"), (5, "input_key", "input_path"), (6, "input_path", "input_key")], "file_no bigint, old string, new string")
    learned = drift.with_synonyms(learned, renames)
    assert drift.same_meaning("source_key", "input_path", learned) and not drift.same_meaning("source_key", "output_path", learned)


def test_changes(spark):
    def lines(file_no, day, *bodies, stream="s"):
        return [(file_no, stream, at(day), k + 1, b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)]

    rows = [
        *lines(1, 0, {"id": 1, "input_size": 5, "e_tag": "abcdef12"}, {"id": 2, "x": None}),
        *lines(9, 2, {"id": 1.5, "inputSize": "7", "A": True}, "no json", None, "[1]"),
        *lines(3, 1, {"id": 1, "input_size": 5, "x": 1, "a": 3}, {"id": 1, "input_size": 5, "x": 1, "a": 3}),
        *lines(4, 3, {"id": 2.5, "inputSize": "7", "A": [True]}),
        *lines(5, 4, {"id": None, "inputSize": {"v": 7}, "A": [1]}),
        *lines(6, 5),
        *lines(7, None, {"q": 1}, stream="t"), *lines(8, 0, {"q": "1"}, stream="t"),
        *lines(10, 0, {"q": 1}, stream=None), *lines(11, 1, {"q": 1, "r": 1}, stream=None),
    ]
    df = spark.createDataFrame(rows + rows[:3], LINES).withColumns({"field": F.lit(1), "change": F.lit(2), "before": F.lit(3)})
    want = {
        (3, "removed", "e_tag"), (3, "added", "a"), (9, "renamed", "inputSize"), (9, "retyped", "inputSize"), (9, "retyped", "id"), (9, "removed", "x"), (9, "removed", "a"), (9, "added", "A"),
        (4, "retyped", "A"), (5, "retyped", "inputSize"), (8, "retyped", "q"), (11, "added", "r"),
    }
    got = [tuple(r) for r in drift.changes(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert drift.changes(df.limit(0)).collect() == []


def test_file_order_in_ranges(spark, monkeypatch):
    dice = random.Random(6)
    files = [(k, dice.choice(["a", "a", "a", "b", None]), at(dice.choice([None, *range(12)]))) for k in range(80)]
    df = spark.createDataFrame([(f, s, w, 1, "{}") for f, s, w in files], LINES)
    want = {}
    for s in ("a", "b", None):
        own = [f for f, _, _ in sorted((x for x in files if x[1] == s), key=lambda x: (x[2] is not None, x[2] or T0, x[0]))]
        want |= dict(zip(own, [None, *own]))
    for n in (50_000, 7):
        monkeypatch.setattr(drift, "RANGE_FILES", n)
        assert {r.file_no: r.before for r in drift.file_order(df).collect()} == want


def test_one_table(spark):
    rows = [(1, "s", at(0), 1, '{"row_count": 3, "tag": [1], "line_no": 5}'), (2, "s", at(1), 1, '{"rowCount": "4", "tag": null}'), (2, "s", at(1), 1, '{"rowCount": "4", "tag": null}'), (2, "s", at(1), 2, "bad")]
    out = drift.one_table(spark.createDataFrame(rows, LINES))
    name = "rowCount" if "rowCount" in out.columns else "row_count"
    assert {"line_no", "line_no_", "tag", name, f"{name}__string", f"{name}__whole"} <= set(out.columns)
    got = sorted(((r.file_no, r.line_no, r[name], r[f"{name}__whole"], r[f"{name}__string"], r.tag) for r in out.collect()), key=str)
    assert got == [(1, 1, "3", 3, None, "[1]"), (2, 1, "4", None, "4", None), (2, 1, "4", None, "4", None), (2, 2, None, None, None, None)]
    fused = {r.field: (r.names, r.types) for r in drift.alternatives(spark.createDataFrame(rows, LINES)).collect()}
    assert fused[name] == (["rowCount", "row_count"], ["string", "whole"]) and fused["tag"][1] == ["array"] and fused["tag[]"] == (["tag"], ["whole"])


def test_one_table_keeps_every_value(spark):
    rows = [(1, "s", at(0), 1, '{"input_key": "a/1", "n": 5}'), (2, "s", at(1), 1, '{"input_path": "a/2", "n": 99999999999999999999}'), (3, "s", at(2), 1, '{"input_key": "left", "input_path": "right", "n": 1}')]
    # both names side by side in a few files only: still one field
    rows += [(k, "s", at(k), 1, json.dumps({"input_key" if k % 3 else "input_path": "a/1", "n": 1})) for k in range(4, 90)] + [(99, "s", at(99), 1, '{"n": 1, "n": 2, "n": 123456789012345678901234567890123456789012345}')]
    out = {r.file_no: r for r in drift.one_table(spark.createDataFrame(rows, LINES)).collect()}
    assert (out[2].input_key, out[3].input_key) == ("a/2", "left")
    assert [tuple(x) for x in out[3]["_conflicts"]] == [("input_key", "input_path", "right")]
    assert (out[1].n, out[2].n, out[2].n__whole) == ("5", "9" * 20, Decimal("9" * 20))
    assert out[99].n == "1" and [x.value for x in out[99]["_conflicts"]] == ["2", "123456789012345678901234567890123456789012345"] and out[1]["_conflicts"] is None


def test_rare_fields_are_kept_by_name(spark, monkeypatch):
    monkeypatch.setattr(drift, "MOST_NAMES", 2)
    rows = [(k, "s", at(k), 1, json.dumps({"a": k, "b": "x", f"key{k}": k})) for k in range(6)]
    out = drift.one_table(spark.createDataFrame(rows, LINES))
    assert out.columns[4:] == ["a", "b", "_conflicts", "_rest"]
    assert {r.file_no: [tuple(x) for x in r["_rest"]] for r in out.collect()} == {k: [(f"key{k}", str(k))] for k in range(6)}


def test_rare_names_count_like_others(spark, monkeypatch):
    """Names beyond the most used ones are told apart, joined and put into columns as the others are."""
    rows = []
    for k in range(60):
        body = {"id": k, "kind": "x y", ("row_count" if k < 50 else "rowCount"): k}
        # a rare pair that stands side by side shows that left and right exclude each other
        if k % 4 == 0:
            body |= {"left_weight": k, "right_weight": k}
        body |= {"left_depth": k} if k % 2 else {"right_depth": k}
        # words that take each other's place in several files mean the same
        body |= {"source_at": k} if k % 3 else {"origin_at": k}
        body |= {"source_zone_no": k} if k % 5 else {"origin_zone_nr": k}
        rows.append((k, "s", at(k), 1, json.dumps(body)))
    df = spark.createDataFrame(rows, LINES)

    def found():
        return (
            Counter(map(tuple, drift.changes(df).collect())),
            Counter((r.field, *map(tuple, (r.names, r.types)), r.n_lines, r.first_file) for r in drift.alternatives(df).collect()),
        )

    want = found()
    assert not any(c == "renamed" and f.endswith("depth") for _, c, f in want[0]) and (50, "renamed", "rowCount") in want[0]
    monkeypatch.setattr(drift, "MOST_NAMES", 3)
    assert found() == want
    out = {r.file_no: r for r in drift.one_table(df).collect()}
    assert [r for r in out[0].asDict() if r in ("id", "kind", "row_count", "rowCount")] == ["id", "kind", "row_count"]
    assert (out[7].row_count, out[55].row_count) == (7, 55)
    assert all("rowCount" not in [x["name"] for x in r["_rest"] or ()] for r in out.values()) and "left_depth" in [x["name"] for x in out[55]["_rest"]]


def test_linked_names(spark, monkeypatch):
    dice = random.Random(8)
    links = [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)] + [(f"n{dice.randrange(90)}", f"n{dice.randrange(90)}") for _ in range(60)]
    dice.shuffle(links)
    want: dict[str, set[str]] = {}
    for u, v in links:
        if u != v:
            group = want.get(u, {u}) | want.get(v, {v})
            want |= dict.fromkeys(group, group)
    got = {r.field: r.root for r in drift.components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {n: min(g) for n, g in want.items()}
    # in the driver and by joins
    lines = {n: dice.randrange(5) for n in want}
    fields = spark.createDataFrame([(1, n, k) for n, k in lines.items()], "file_no bigint, field string, n_lines bigint")
    for most in (scale.BROADCAST_BYTES, 0):
        monkeypatch.setattr(scale, "BROADCAST_BYTES", most)
        got = {r.field: r.one for r in drift.one_names(fields, spark.createDataFrame(links, "old string, new string")).collect()}
        assert got == {n: min(g, key=lambda x: (-lines[x], x)) for n, g in want.items()}


def test_nested_alternatives(spark):
    bodies = ['{"a": {"b": [1, "x", {"c": 1.5}], "d": null}}', '{"a": {"b": 7}}', '{"a": "text"}', '{"a": {"b": [[true]]}}', "{'a': 1}", '{"a": 1', None]
    rows = [(k, "s", at(k), 1, b) for k, b in enumerate(bodies)]
    got = {r.field: r.types for r in drift.alternatives(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {"a": ["string", "object"], "a.b": ["whole", "array"], "a.d": [], "a.b[]": ["string", "whole", "array", "object"], "a.b[].c": ["decimal"], "a.b[][]": ["boolean"]}


# --- problem 5


@pytest.mark.parametrize("split, block", [(7, 2), (1_000_000, 32_768)])
def test_per_key(spark, monkeypatch, split, block):
    monkeypatch.setattr(hotkeys, "SPLIT_ROWS", split)
    monkeypatch.setattr(hotkeys, "BLOCK_KEYS", block)
    dice = random.Random(8)
    rows = [(1 if k % 3 == 0 else dice.choice([None, 2, 3, -4, 10**15]), dice.choice([None, "", "a", "a ", "A", "x" * 3000]), at(dice.choice([None, 0, 1, 5]))) for k in range(700)]
    df = spark.createDataFrame(rows, "order_id bigint, carrier string, shipped_at timestamp_ntz").withColumns({"block": F.lit(1), "n_rows": F.lit(2), "field": F.lit("f")}).repartition(5)
    want = {}
    for field, k in (("order_id", 0), ("carrier", 1)):
        for r in rows:
            if r[k] is not None:
                n, times = want.get((field, str(r[k])), (0, []))
                want[field, str(r[k])] = (n + 1, [*times, r[2]] if r[2] else times)
    got = {(r.field, r.key_value): (r.n_rows, r.first_at, r.last_at) for r in hotkeys.per_key(df, ["order_id", "carrier"], "shipped_at").collect()}
    assert got == {k: (n, min(t, default=None), max(t, default=None)) for k, (n, t) in want.items()}
    heavy = {tuple(r) for r in hotkeys.heavy_keys(hotkeys.per_key(df, ["order_id", "carrier"], "shipped_at"), len(rows), 0.3).collect()}
    assert heavy == {k for k, (n, _) in want.items() if n >= 0.3 * len(rows)}


def test_per_key_of_nothing(spark):
    df = spark.createDataFrame([], "order_id bigint, carrier string, shipped_at timestamp_ntz")
    assert hotkeys.per_key(df, ["order_id", "carrier"], "shipped_at").collect() == []
    assert hotkeys.heavy_keys(hotkeys.per_key(df, ["carrier"], "shipped_at"), 0).collect() == []


def test_splits_are_equal_and_a_hot_key_leaves_each_once():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(["hot"] * 90 + [str(k)] * 10), pa.nulls(100, pa.timestamp("us"))], names=["k", "at"]) for k in range(10)]
    sent = pa.Table.from_batches(hotkeys._reduce_splits(1, 1, 250)(iter(batches)))
    assert [sum(n) for n in sent["n"].to_pylist()] == [250] * 4 and all(k.count("hot") == 1 for k in sent["keys"].to_pylist())


# --- problem 6

SIDE = "id bigint, load_no int, amount decimal({0}), note string"


def compare(spark, left, right):
    a = spark.createDataFrame(left, SIDE.format("10,2")).withColumns({"_k": F.lit(1), "difference": F.lit(2)})
    b = spark.createDataFrame(right, SIDE.format("14,4"))
    return sorted(tuple(r)[1:] for r in differences.differences(a, b, ["id", "load_no"], ["amount", "note"], "d").collect())


def brute(left, right):
    out = []
    keys = {r[:2] for r in left} | {r[:2] for r in right}
    for k in keys:
        a, b = ([r[2:] for r in side if r[:2] == k] for side in (left, right))
        name = "/".join("\\N" if x is None else str(x) for x in k)
        if not a or not b:
            out.append((name, "only_right" if not a else "only_left"))
            continue
        out += [(name, f) for i, f in enumerate(("amount", "note")) if {r[i] for r in a} != {r[i] for r in b}]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_differences_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(differences, "BUCKET_ROWS", 50)
    dice = random.Random(seed)
    left = [(k if k % 50 else None, k % 3, None if k % 7 == 0 else Decimal(k), dice.choice([None, "", "a", "\\N", "x" * 2000])) for k in range(400)]
    right = []
    for r in left:
        x = dice.random()
        if x < 0.04:
            continue
        if x < 0.08:
            r = (*r[:2], Decimal("0.0001"), r[3])
        elif x < 0.12:
            r = (*r[:3], "b" if r[3] is None else None)
        right += [r] * dice.choice([1, 1, 2])
    right += [(1000 + k, 1, Decimal(1), "new") for k in range(9)] + [(3, 0, Decimal(77), "second row of a key")]
    left += left[:30]
    dice.shuffle(right)
    assert compare(spark, left, right) == brute(left, right)


def test_differences_at_the_ends(spark):
    rows = [(1, 1, Decimal("1.50"), None), (2, 1, None, "")]
    assert compare(spark, [], []) == compare(spark, rows, rows * 2) == []
    assert compare(spark, rows, []) == [("1/1", "only_left"), ("2/1", "only_left")]
    assert compare(spark, [], rows) == [("1/1", "only_right"), ("2/1", "only_right")]


def test_parts_of_keys_stay_apart(spark):
    kinds = "a string, b string, v int"
    one, two = spark.createDataFrame([("a/b", "c", 1), (None, "x", 1)], kinds), spark.createDataFrame([("a", "b/c", 1), ("\\N", "x", 1)], kinds)
    got = Counter(tuple(r)[1:] for r in differences.differences(one, two, ["a", "b"], ["v"], "d").collect())
    assert got == {("a/b/c", "only_left"): 1, ("a/b/c", "only_right"): 1, ("\\N/x", "only_left"): 1, ("\\N/x", "only_right"): 1}


@pytest.mark.parametrize("seed", range(2))
def test_a_hot_key_is_spread(spark, monkeypatch, seed):
    monkeypatch.setattr(differences, "BUCKET_ROWS", 100)
    dice = random.Random(seed)
    left = [(1 if k % 3 == 0 else k, 1, Decimal(k % 50), "same" if k % 2 else None) for k in range(3000)]
    right = [r for r in left if dice.random() > 0.01] + [(1, 1, Decimal("0.5"), "x")]
    assert compare(spark, left, right) == brute(left, right)
    a = spark.createDataFrame(left, SIDE.format("14,4"))
    sides = [differences._normal(a, a, ["id", "load_no"], ["amount", "note"])] * 2
    hot = sides[0].where("_k0 = '1'").first()["_h"]
    sizes = [r.n for r in differences.chunked(sides, 8, [hot]).where(F.col("_h") == hot).groupBy(F.pmod("_b", F.lit(8))).agg(F.count("*").alias("n")).collect()]
    # fifty different rows on each side
    assert len(sizes) == 8 and sum(sizes) == 100


def test_one_change_leaves_most_chunks_alone(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    b = a.where("k <> 777")
    sides = [differences._normal(x, a, ["k"], ["v"]) for x in (a, b)]
    chunks = differences.prints(differences.chunked(sides, 4))
    n = {r.side: r.n for r in chunks.groupBy(F.col("_side").alias("side")).agg(F.count("*").alias("n")).collect()}
    both = chunks.groupBy("_b", "_p1", "_p2", "_n").agg(F.countDistinct("_side").alias("m")).where("m = 2").count()
    assert n[0] > 1000 and n[0] - both <= 2
    key = sides[0].where("_k0 = '777'").first()["_h"]
    assert [r["_h"] for r in differences.differing(sides, 4).collect()] == [key]


# --- the queries on the test tables


#: Their SQL states which names belong to one field; the smallest table has too few files to show all of these renames.
MANY_FILES = ("p4_alternatives", "p4_table_counts")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_sql(spark, sf, name):
    sf = sf.replace("sf0.001", "sf0.01") if name in MANY_FILES else sf
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, want = queries.QUERIES[name](spark, sf), c.sql(queries.ORACLES[name])
    cols = list(want.columns)
    assert sorted(cols) == sorted(df.columns)
    assert Counter(map(str, map(tuple, df.select(*cols).collect()))) == Counter(map(str, want.fetchall()))

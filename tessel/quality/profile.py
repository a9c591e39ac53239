"""Column-level data quality profile of every load, with column expressions by minimum description length.

Rows are reduced to the different values of each load and column with their counts.  Expressions are induced from all
different values of a column: a value has four nested shapes, from its exact one to its set of sign classes, and the tree
of shapes is cut where that makes the description of all different values shortest.  An expression costs its own length
and, for each value, the bits that single the value out among all it can describe.

The expressions that stand for a hundredth of a column's different values or more (a hundred of them at most) are the
column's own.  As regular expressions they are run on the values: the first that matches has the value.  Each is held
against the declared pattern once, as a language: wholly inside, wholly outside, or mixed; only values under a mixed one
or under none are checked singly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import cut, sized_join

#: Hundredths of a bit for one sign of an expression, for a run of unknown length in it, and for a letter of either case.
SIGN_BITS, RUN_BITS, LETTER_BITS = 800, 400, 650
#: Hundredths of a bit for one sign of a class: A-Z, a-z, other letters, digits.
CLASS_BITS = {"A": 470, "a": 470, "L": 1100, "9": 332}
#: Share of different values from which an expression is the column's own, and the signs it may have to be run as a regular
#: expression; values of longer ones are checked singly.
OWN_SHARE, OWN_SIGNS = 0.01, 1000
#: Accuracy of the quantiles next to the median, and how far from the middle they are taken.
ACCURACY, NEXT = 1000, 0.0015
#: Stands between a table's and a column's name while both are one key.
_OF = "\x00"
#: The regular expression of each sign of an expression that stands for a class; all else stands for itself.
_OTHER = r"[^\P{L}A-Za-z]"
CLASSES = {"A": "[A-Z]", "a": "[a-z]", "L": _OTHER, "9": "[0-9]", "B": "[A-Z]{2,}", "b": "[a-z]{2,}", "M": _OTHER + "{2,}", "8": "[0-9]{2,}"}


@dataclass(frozen=True)
class ColumnRule:
    """How a column is measured.  ``breaks`` says of a value whether it breaks the declared pattern; ``outside`` whether it is out
    of range.

    A declared pattern may ask which signs begin and end a value, which occur in it and which follow each other, and must
    treat all letters alike and all digits alike; so it can be asked of an expression as of a value.
    """

    name: str
    breaks: Callable[[Column], Column] | None = None
    outside: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Expression:
    """An own expression of a column: its level in the tree, its regular expression, how many different values induced it, and what
    it says of the declared pattern."""

    column: str
    level: int
    regex: str
    n_values: int
    verdict: str = "mixed"


def note_breaks(x: Column) -> Column:
    """Blank, white space at an end, a control character other than line feed, or U+FFFD."""
    return (x == "") | x.rlike(r"^\p{IsWhite_Space}|\p{IsWhite_Space}\z|[\p{Cc}&&[^\n]]|\x{FFFD}")


def name_breaks(x: Column) -> Column:
    """Not a letter first, or anything but letters, ``'``, ``.``, ``-`` and spaces that a letter follows.

    Said by what may not occur, so that a text of any length is checked without recursion."""
    return (x == "") | x.rlike(r"^[^\p{L}]|[^\p{L}'. -]| [^\p{L}]| \z")


def amount_outside(x: Column) -> Column:
    return (x < 0.01) | (x > 20000)


def value_counts(df: DataFrame, columns: list[str], load: str = "load_no", names: list[str] | None = None) -> DataFrame:
    """``load_no``, ``column_name``, ``value`` (as text) and ``n``: the different values of each load.  ``names`` are other names for
    the columns."""
    cells = [F.struct(F.lit(name).alias("c"), F.col(c).cast("string").alias("v")) for c, name in zip(columns, names or columns)]
    rows = df.select(F.col(load).alias("load_no"), F.explode(F.array(*cells)).alias("_x"))
    return rows.groupBy("load_no", F.col("_x.c").alias("column_name"), F.col("_x.v").alias("value")).agg(F.count("*").alias("n"))


def exact_shape(v: Column) -> Column:
    """Letters and digits become A, a, L and 9; other signs stand for themselves, so the declared patterns hold for a shape
    as for its values."""
    plain = F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "9" * 10)
    return F.when(plain.rlike(r"[^\x00-\x7f]"), F.regexp_replace(plain, r"[\p{L}&&[^A-Za-z]]", "L")).otherwise(plain)


def _wider_shapes(e1: Column) -> list[Column]:
    """The three wider expressions of an exact shape, each nested in the next: runs of a class (B, b, M, 8), runs of letters (w) and
    digits, and the set of signs.  No shape has other letters or digits, so these marks are free, and they are letters and
    digits themselves."""
    e2 = reduce(lambda e, m: F.regexp_replace(e, m[0] + "{2,}", m[1]), (("A", "B"), ("a", "b"), ("L", "M"), ("9", "8")), e1)
    e3 = F.regexp_replace(F.regexp_replace(e1, "[AaL]+", "w"), "9+", "8")
    return [e2.alias("e2"), e3.alias("e3"), F.array_join(F.array_sort(F.array_distinct(F.split(e3, ""))), "").alias("e4")]


def _bits(level: int) -> Column:
    """Hundredths of bits that single out a value among all that its expression of a level describes."""
    e1, e2, e3, e4 = (F.col(f"e{k}") for k in (1, 2, 3, 4))
    count = lambda e, signs: F.length(e) - F.length(F.translate(e, signs, ""))
    if level <= 2:
        exact = sum((count(e1, c) * bits for c, bits in CLASS_BITS.items()), F.lit(0))
        return exact if level == 1 else exact + count(e2, "BbM8") * RUN_BITS
    if level == 3:
        return count(e1, "9") * CLASS_BITS["9"] + count(e1, "AaL") * LETTER_BITS + count(e3, "w8") * RUN_BITS
    signs = F.when(e4.contains("w"), 56).otherwise(0) + F.when(e4.contains("8"), 10).otherwise(0) + F.length(e4)
    return 1000 + F.length(e1) * F.floor(F.log2(signs.cast("double") + 1) * 100 + 0.000001)


def _regex(level: int, signs: str) -> str:
    """The regular expression of an expression, for Java as for RE2."""
    plain = lambda c: "\\" + c if c.isascii() and not c.isalnum() else c
    if level < 4:
        own = CLASSES if level < 3 else {"w": r"\p{L}+", "8": "[0-9]+"}
        return "".join(own.get(c) or plain(c) for c in signs)
    return "[" + "".join({"w": r"\p{L}", "8": "0-9"}.get(c) or plain(c) for c in signs) + "]+" if signs else ""


def expressions(cells: DataFrame, breaks: dict[str, Callable[[Column], Column]] | None = None) -> dict[str, list[Expression]]:
    """The own expressions of each column, in the order in which they are tried: narrower levels first, then by number of values.

    All that is wider than an exact shape is made from the different shapes, not from the values.  A node of the tree that
    has a hundredth of the values lies under nodes that have so, too; only those come to the driver, a hundred of each
    level at most.
    """
    values = cells.where(F.col("value").isNotNull()).select("column_name", "value").distinct()
    tree = values.groupBy("column_name", exact_shape(F.col("value")).alias("e1")).agg(F.count("*").alias("n"))
    tree = tree.select("column_name", "e1", "n", *_wider_shapes(F.col("e1"))).select("*", *((F.col("n") * _bits(k)).alias(f"s{k}") for k in (1, 2, 3, 4)))
    tree = cut(tree)
    least = {r.column_name: OWN_SHARE * r.n for r in tree.groupBy("column_name").agg(F.sum("n").alias("n")).collect()}
    if not least:
        return {}
    enough = reduce(lambda e, c: F.when(F.col("column_name") == c, F.col("n") >= least[c]).otherwise(e), least, F.lit(False))
    node = tree.select("column_name", "e1", "e2", "e3", "e4", "n", (F.length("e1") * SIGN_BITS + F.col("s1")).alias("best"), F.lit(True).alias("taken"), "s2", "s3", "s4")
    found = [node.where(enough)]
    for level, keys in ((2, ["e2", "e3", "e4"]), (3, ["e3", "e4"]), (4, ["e4"])):
        sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(level, 5)]
        node = node.groupBy("column_name", *keys).agg(F.sum("n").alias("n"), F.sum("best").alias("parts"), *sums)
        own = F.length(f"e{level}") * SIGN_BITS + F.col(f"s{level}")
        node = node.withColumns({"taken": own < F.col("parts"), "best": F.least(own, "parts")}).drop("parts")
        found.append(node.where(enough))
    found = [x.select("column_name", F.lit(k + 1).alias("level"), *(F.col(e) if e in x.columns else F.lit(None).cast("string").alias(e) for e in ("e1", "e2", "e3", "e4")), "n", "taken") for k, x in enumerate(found)]
    nodes = reduce(DataFrame.unionByName, found).collect()
    ruling = {(r.column_name, r.level, r[f"e{r.level}"]) for r in nodes if r.taken}
    # the widest expression that was taken rules over those inside it
    own = [r for r in nodes if r.taken and not any((r.column_name, k, r[f"e{k}"]) in ruling for k in range(r.level + 1, 5))]
    own = [(r.column_name, r.level, r[f"e{r.level}"], r.n) for r in own if len(r[f"e{r.level}"]) <= OWN_SIGNS]
    verdicts = _verdicts(cells.sparkSession, own, breaks or {})
    out: dict[str, list[Expression]] = {c: [] for c in least}
    for c, level, signs, n in sorted(own, key=lambda x: (x[0], x[1], -x[3], x[2])):
        out[c].append(Expression(c, level, _regex(level, signs), n, verdicts[c, level, signs]))
    return out


def _verdicts(spark: SparkSession, own: list[tuple[str, int, str, int]], breaks: dict[str, Callable[[Column], Column]]) -> dict[tuple[str, int, str], str]:
    """What each expression says of the declared pattern of its column, asked once.

    Up to level 3 the expression is itself a text of its language, and all others differ from it only within classes and
    runs, so it speaks for all.  A set of signs is inside if every sign and every pair of signs fits, else mixed.
    """
    if not own:
        return {}
    signs = F.split(F.when(F.col("level") == 4, F.col("signs")).otherwise(""), "")
    pairs = F.flatten(F.transform(signs, lambda a: F.transform(signs, lambda b: F.concat(a, b))))
    out = F.lit("mixed")
    for c, broken in breaks.items():
        whole = F.when(broken(F.col("signs")), "outside").otherwise("inside")
        of_set = F.when(F.exists(F.concat(signs, pairs), broken), "mixed").otherwise("inside")
        out = F.when(F.col("column_name") == c, F.when(F.col("level") < 4, whole).otherwise(of_set)).otherwise(out)
    rows = spark.createDataFrame([x[:3] for x in own], "column_name string, level int, signs string").withColumn("verdict", out)
    return {(r.column_name, r.level, r.signs): r.verdict for r in rows.collect()}


def matched(own: dict[str, list[Expression]]) -> Column:
    """The place of the first own expression of its column that a value matches as a whole; -1 for none."""
    out = F.lit(-1)
    for c, found in own.items():
        place = F.lit(-1)
        for k, e in reversed(list(enumerate(found))):
            place = F.when(F.col("value").rlike(rf"\A(?:{e.regex})\z"), F.lit(k)).otherwise(place)
        out = F.when(F.col("column_name") == c, place).otherwise(out)
    return out


def judged(cells: DataFrame, own: dict[str, list[Expression]], breaks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``load_no``, ``column_name``, ``n_break``, ``n_checked`` (values checked singly) and ``n_covered`` (under an own expression)."""
    rows = cells.where(F.col("value").isNotNull() & F.col("column_name").isin(list(own))).withColumn("_e", matched(own))
    breaking, single = F.lit(False), F.lit(False)
    for c, found in own.items():
        if c in breaks:
            of = {v: [k for k, e in enumerate(found) if e.verdict == v] for v in ("inside", "outside")}
            in_bulk = F.when(F.col("_e").isin(of["inside"]), False).when(F.col("_e").isin(of["outside"]), True)
            breaking = F.when(F.col("column_name") == c, F.coalesce(in_bulk, breaks[c](F.col("value")))).otherwise(breaking)
            single = F.when(F.col("column_name") == c, in_bulk.isNull()).otherwise(single)
    count = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    return rows.groupBy("load_no", "column_name").agg(count(breaking).alias("n_break"), count(single).alias("n_checked"), count(F.col("_e") >= 0).alias("n_covered"))


def _measured(df: DataFrame, c: str) -> Column:
    """What a column's level is taken of: its number, or the length of its text."""
    return F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.length(F.col(c).cast("string")).cast("double")


def _plain_measures(df: DataFrame, rules: list[ColumnRule], columns: list[str], load: str, extremes: bool) -> DataFrame:
    """One row for each load and column: counts, range and the two quantiles next to the median, in one pass."""
    aggs = []
    for k, (r, c) in enumerate(zip(rules, columns)):
        x, number, text = _measured(df, c), isinstance(df.schema[c].dataType, T.NumericType), F.col(c).cast("string")
        none = F.lit(None)
        aggs.append(
            F.struct(
                F.lit(r.name).alias("column_name"), F.count("*").alias("n_rows"), F.count(c).alias("n_values"),
                (F.min(x) if number and extremes else none.cast("double")).alias("least_number"), (F.max(x) if number and extremes else none.cast("double")).alias("greatest_number"),
                (F.min(text) if extremes else none.cast("string")).alias("least_text"), (F.max(text) if extremes else none.cast("string")).alias("greatest_text"),
                (F.sum(F.when(r.outside(x), 1).otherwise(0)) if r.outside else F.lit(0)).cast("bigint").alias("n_outside"),
                F.percentile_approx(x, [0.5 - NEXT, 0.5 + NEXT], ACCURACY).alias("_next"),
            ).alias(f"_{k}")
        )
    wide = df.groupBy(F.col(load).alias("load_no")).agg(*aggs)
    return wide.select("load_no", F.explode(F.array(*(f"_{k}" for k in range(len(rules))))).alias("_x")).select("load_no", "_x.*")


def _quantiles(measures: DataFrame) -> DataFrame:
    """One row for each load: the quantiles next to the median of each column."""
    return cut(measures.where(F.col("n_values") > 0).groupBy(F.struct("load_no").alias("_l")).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "_next"))).alias("_near")))


def _middle(df: DataFrame, rules: list[ColumnRule], columns: list[str], load: str, near: DataFrame) -> DataFrame:
    """``load_no``, ``column_name``, ``x``, ``n``: counts of the values around the middle; a null ``x`` stands for all below them.

    A load may hold most rows: what lies below the quantiles next to the median is only counted, and what lies between
    them, some thousandths of the rows, is counted by value.
    """
    rows = df.select(F.struct(F.col(load).alias("load_no")).alias("_l"), *(_measured(df, c).alias(f"_{k}") for k, c in enumerate(columns)))
    rows = sized_join(rows, near, ["_l"])
    cells = F.array(*(F.struct(F.lit(r.name).alias("c"), F.col(f"_{k}").alias("x"), F.col("_near")[r.name].alias("near")) for k, r in enumerate(rules)))
    rows = rows.select("_l", F.explode(cells).alias("_x")).where(F.col("_x.x") <= F.col("_x.near")[1])
    between = F.when(F.col("_x.x") >= F.col("_x.near")[0], F.col("_x.x"))
    return rows.groupBy(F.col("_l.load_no").alias("load_no"), F.col("_x.c").alias("column_name"), between.alias("x")).agg(F.count("*").alias("n"))


def medians(counts: DataFrame, measures: DataFrame) -> DataFrame:
    """The exact median of each load and column from the counts of ``_middle``."""
    key = F.struct("load_no", "column_name").alias("_k")
    order = Window.partitionBy("_k").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(key, "x", "n").withColumn("end", F.sum("n").over(order))
    placed = placed.join(measures.select(key, ((F.col("n_values") - 1) / 2).alias("_at")), "_k")
    holds = lambda at: (F.col("end") - F.col("n") <= at) & (at < F.col("end"))
    ends = [F.max(F.when(holds(at(F.col("_at")).cast("bigint")), F.col("x"))) for at in (F.floor, F.ceil)]
    return placed.groupBy("_k").agg(((ends[0] + ends[1]) / 2).alias("level"))


def profile(df: DataFrame, table_name: str, rules: list[ColumnRule], load: str = "load_no") -> DataFrame:
    """``profiles`` of one table."""
    return profiles([(df, table_name, rules)], load)


def profiles(tables: list[tuple[DataFrame, str, list[ColumnRule]]], load: str = "load_no", full: bool = True) -> DataFrame:
    """One row for each load and column of each table: counts, range, median and the shares of rows that break patterns.

    ``tables`` are data, name and rules; the rules name the columns.  ``coverage`` is the share of non-null values under the
    column's own expressions, ``pattern_share`` the share that breaks the declared pattern, ``n_checked`` how many rows had to
    be checked singly for it.  Without ``full`` the extremes are null, and only columns with a pattern have expressions.

    Repeated rows count as stored.  Measures of a load without non-null values are null; a null load is a load; empty
    texts are values; an empty table gives no row.  All tables are profiled in the same jobs.
    """
    named = [(df, [replace(r, name=f"{table}{_OF}{r.name}") for r in rules], [r.name for r in rules]) for df, table, rules in tables]
    rules = [r for _, own, _ in named for r in own]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    measures = cut(union([_plain_measures(df, own, columns, load, full) for df, own, columns in named]))
    near = _quantiles(measures)
    middle = medians(union([_middle(df, own, columns, load, near) for df, own, columns in named]), measures)
    cells = cut(union([value_counts(df, columns, load, [r.name for r in own]) for df, own, columns in named]))
    breaks = {r.name: r.breaks for r in rules if r.breaks}
    of = cells if full else cells.where(F.col("column_name").isin(list(breaks)))
    found = judged(cells, expressions(of, breaks), breaks)
    has_range, has_pattern = (F.col("column_name").isin([r.name for r in rules if getattr(r, k)]) for k in ("outside", "breaks"))
    key = F.struct("load_no", "column_name").alias("_k")
    out = measures.select(key, "*")
    distinct = cells.groupBy("load_no", "column_name").agg(F.count("value").alias("n_distinct"))
    for part in (distinct.select(key, "n_distinct"), found.select(key, *found.columns[2:]), middle):
        out = out.join(part, "_k", "left")
    share = lambda x: F.when(F.col("n_values") > 0, F.col(x) / F.col("n_values"))
    return out.select(
        F.substring_index("column_name", _OF, 1).alias("table_name"), F.substring_index("column_name", _OF, -1).alias("column_name"),
        "load_no", "n_rows", "n_values", "n_distinct",
        "least_number", "greatest_number", "least_text", "greatest_text",
        ((F.col("n_rows") - F.col("n_values")) / F.col("n_rows")).alias("null_share"), share("n_distinct").alias("distinct_share"),
        F.when(has_pattern, share("n_break")).alias("pattern_share"), F.when(has_range, share("n_outside")).alias("range_share"),
        share("n_covered").alias("coverage"), F.when(has_pattern, F.coalesce("n_checked", F.lit(0))).alias("n_checked"), F.col("level").alias("level"),
    )


#: How far a measure may depart from the median M over all loads.
def departs(measure: Column, value: Column, middle: Column) -> Column:
    return (
        F.when(measure == "null_share", F.abs(value - middle) > 0.15)
        .when(measure == "distinct_share", value < middle / 2)
        .when(measure == "pattern_share", value > middle + 0.10)
        .when(measure == "range_share", value > middle + 0.03)
        .when(measure == "coverage", value < middle - 0.10)
        .when(measure == "level", (value > 1.6 * middle) | (value < middle / 1.6))
    )


def departures(profiles: DataFrame, measures: list[str]) -> DataFrame:
    """``table_name``, ``column_name``, ``load_no``, ``measure``, ``value``, ``median`` of the loads that depart from the median."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures)))
    long = profiles.select("table_name", "column_name", "load_no", cells.alias("_x")).select("table_name", "column_name", "load_no", F.col("_x.m").alias("measure"), F.col("_x.v").alias("value"))
    long = long.where(F.col("value").isNotNull())
    middle = long.groupBy("table_name", "column_name", "measure").agg(F.expr("percentile(value, 0.5)").alias("median"))
    both = long.join(middle, ["table_name", "column_name", "measure"])
    return both.where(departs(F.col("measure"), F.col("value"), F.col("median"))).select("table_name", "column_name", "load_no", "measure", "value", "median")


def expression_shares(tables: list[tuple[DataFrame, str, list[str]]], load: str = "load_no") -> DataFrame:
    """``table_name``, ``column_name``, ``load_no``, ``expression``, ``n_rows``, ``share``: how the values of a load are spread over the own
    expressions of their column; a null expression stands for values under none."""
    named = [(df, columns, [f"{table}{_OF}{c}" for c in columns]) for df, table, columns in tables]
    cells = cut(reduce(DataFrame.unionByName, [value_counts(df, columns, load, names) for df, columns, names in named])).where(F.col("value").isNotNull())
    own = expressions(cells)
    text = F.lit(None).cast("string")
    for c, found in own.items():
        if found:
            text = F.when(F.col("column_name") == c, F.get(F.array(*(F.lit(e.regex) for e in found)), F.col("_e"))).otherwise(text)
    n = cells.withColumn("_e", matched(own)).withColumn("expression", text).groupBy("load_no", "column_name", "expression").agg(F.sum("n").alias("n_rows"))
    # one row for each load, column and own expression
    every = Window.partitionBy("load_no", "column_name")
    n = n.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(every))
    return n.select(F.substring_index("column_name", _OF, 1).alias("table_name"), F.substring_index("column_name", _OF, -1).alias("column_name"), "load_no", "expression", "n_rows", "share")


def coverage_changes(shares: DataFrame, least: float = 0.1) -> DataFrame:
    """The expressions whose share in a load departs from the median of its shares in all loads of the column by more than ``least``.

    ``table_name``, ``column_name``, ``load_no``, ``expression``, ``share``, ``median``; a load without the expression has share 0.
    """
    shares = cut(shares)
    column = ["table_name", "column_name"]
    loads = shares.select(*column, F.struct("load_no").alias("_l")).distinct()
    grid = loads.join(shares.select(*column, F.struct("expression").alias("_e")).distinct(), column)
    own = shares.select(*column, F.struct("load_no").alias("_l"), F.struct("expression").alias("_e"), "share")
    grid = grid.join(own, [*column, "_l", "_e"], "left").fillna(0.0, ["share"])
    middle = grid.groupBy(*column, "_e").agg(F.expr("percentile(share, 0.5)").alias("median"))
    both = grid.join(middle, [*column, "_e"]).where(F.abs(F.col("share") - F.col("median")) > least)
    return both.select(*column, "_l.load_no", "_e.expression", "share", "median")

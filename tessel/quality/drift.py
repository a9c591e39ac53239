"""Schemas that drift between files, by tagged-union inference.

Bodies are parsed inside the JVM into maps of variants.  Each field of a file is reduced to a mask of the JSON types of its
non-null values; masks are combined, so files and lines fuse in parallel and every alternative type is kept, at nested
paths as at the top.  Where a rename is in question, the shapes of the texts are looked at, too.  A file is compared with the one before it in its stream; a field
that goes and one that comes are a rename if their names share words and their values share a shape, unless the data show
that they differ: names that stand side by side in files are different fields, and two such names that differ in one word
show that the two words exclude each other.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field as part

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scale
from ..scale import cut, in_ranges, size_of, sized_join

#: JSON types and their bits; one more bit says that a number needs more than 64 bits.
TYPES = ("string", "whole", "decimal", "boolean", "array", "object")
WIDE = 1 << len(TYPES)
#: Least share of words that two names must have in common to be of the same meaning.
SAME_MEANING = 0.5
#: Names in at least this share of the files of the rarer one are different fields.
SIDE_BY_SIDE = 0.05
#: Up to so many names, what they say is learned in the driver, beyond by joins; and columns that a table gets: values of rarer fields are
#: kept by name.
MOST_NAMES = 2_000
#: What a line is reduced to for the table.
CELLS = "array<struct<name:string,k:int,t:string>>"
#: Files in a range of the order within streams, about.
RANGE_FILES = 50_000


def name_words(name: str) -> frozenset[str]:
    """The words of a field name in lower case and singular."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[A-Z]|[0-9]+|[^\W\d_a-zA-Z]+", name)
    words = (w.lower() for w in parts)
    return frozenset(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words) or frozenset([name])


@dataclass(frozen=True)
class Learned:
    """What the files say about names: pairs of different fields, pairs of words that exclude each other, and words that stand
    for another one of the same meaning."""

    different: frozenset[frozenset[str]] = part(default_factory=frozenset)
    exclusive: frozenset[frozenset[str]] = part(default_factory=frozenset)
    same: dict[str, str] = part(default_factory=dict)


def _split_words(a: str, b: str, same: dict[str, str] = {}) -> tuple[int, list[str], list[str]]:  # noqa: B006
    """How many words two names share, and the other words of each; a word is shared with a longer one that begins with it
    (three letters at least)."""
    left, right = (sorted({same.get(w, w) for w in name_words(n)}) for n in (a, b))
    shared = 0
    for x in left[:]:
        like = [y for y in right if x == y] or [y for y in right if min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x))]
        if like:
            shared += 1
            left.remove(x)
            right.remove(like[0])
    return shared, left, right


def same_meaning(a: str, b: str, learned: Learned = Learned()) -> float:
    """Share of common words of two names, by the shorter name; 0 if they share too little or are known to differ."""
    shared, left, right = _split_words(a, b, learned.same)
    share = shared / (shared + min(len(left), len(right)))
    if share < SAME_MEANING or frozenset((a, b)) in learned.different or any(frozenset((x, y)) in learned.exclusive for x in left for y in right):
        return 0.0
    return share + shared / (shared + len(left) + len(right)) / 10


def _parsed(body: Column, exact: bool) -> tuple[Column, Column]:
    """A body as a map of variants, and its values as written, where they are asked for.

    A repeated key stands twice.  A body that is not one JSON object has no field.  Values as written are read where a body
    has numbers that parsing may change: with ``exact`` all but whole ones of 64 bits, else whole ones beyond.
    """
    options = {"allowSingleQuotes": "false"}
    digits = r"[0-9]{19}|[0-9][.eE]" if exact else r"[0-9]{19}"
    return F.from_json(body, "map<string,variant>", options), F.map_values(F.when(body.rlike(digits), F.from_json(body, "map<string,string>", options)))


def _kind(s: Column, raw: Column) -> tuple[Column, Column]:
    """The type of a value from its schema, and whether it is a number that 64 bits do not hold as it is.  A null value has no type.

    A schema of many digits without a fraction is that of a whole number, unless the number is known as written."""
    digits = F.regexp_extract(s, r"^DECIMAL\(([0-9]+),", 1)
    whole = F.coalesce(raw.rlike(r"^-?[0-9]+\z"), s.rlike(r"^DECIMAL\((19|[23][0-9]),0\)"))
    kind = (
        F.when(s.isNull() | (s == "VOID"), F.lit(None).cast("int")).when(s == "STRING", 0).when(s == "BIGINT", 1).when(s == "BOOLEAN", 3).when(s.startswith("ARRAY"), 4)
        .when(s.startswith("OBJECT"), 5).when(whole, 1).otherwise(2)
    )
    exact = F.when(s == "DOUBLE", F.length(F.regexp_replace(F.coalesce(raw, F.lit("")), "[eE].*|[^0-9]", "")) <= 15).otherwise(digits.try_cast("int") <= 15)
    return kind, F.when(~s.startswith("D"), False).otherwise(F.coalesce(~exact, F.lit(False)))


def _text(kind: Column, j: Column, raw: Column) -> Column:
    """The text of a value of a type from its JSON text; arrays and objects stay JSON text."""
    text = F.from_json(F.concat(F.lit('{"x":'), j, F.lit("}")), "x string")["x"]
    plain = F.when(j.contains("\\"), text).otherwise(F.substr(j, F.lit(2), F.length(j) - 2))
    return F.when(kind == 0, plain).when(kind.isin(1, 2), F.coalesce(raw, j)).when(kind.isNotNull(), j)


def _number_shape(x: Column) -> Column:
    """Seconds or milliseconds of this time, or any other number."""
    whole = F.substring_index(x, ".", 1)
    return F.when(F.length(whole).isin(10, 13) & F.substring(x, 1, 1).isin("1", "2"), "time").otherwise("number")


def _text_shape(x: Column) -> Column:
    """The shape of a text: kind of number, time or hexadecimal text, free text, or the text with digits made alike.

    What a text can be is told from its first sign, so most patterns need not be tried."""
    first = F.substring(x, 1, 1)
    number = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
    of_digits = (
        F.when(x.rlike(number), _number_shape(x)).when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]|\z)"), "time")
    )
    of_digits = F.when((first == "-") | first.between("0", "9"), of_digits)
    is_hex = (F.length(x) >= 8) & (first.between("0", "9") | first.between("a", "f") | first.between("A", "F")) & x.rlike(r"^([0-9a-f]+|[0-9A-F]+)\z")
    of_rest = F.when(is_hex, F.concat(F.lit("hex"), F.length(x))).when(x.contains(" ") | x.contains("\n") | x.contains("\t"), "text").otherwise(F.regexp_replace(x, "[0-9]+", "9"))
    return F.coalesce(of_digits, of_rest)


def _inner_shapes(json: Column) -> Column:
    """Hashes of the shapes of all scalars in an array or object."""
    scalars = F.regexp_extract_all(json, F.lit(r'(?:"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|true|false)(?=[,}\]])'), 0)
    plain = F.transform(scalars, lambda x: F.regexp_replace(x, '^"|"$', ""))
    return F.array_distinct(F.transform(plain, lambda x: F.xxhash64(F.when(x.isin("true", "false"), "boolean").otherwise(_text_shape(x)))))


def _values(lines: DataFrame) -> DataFrame:
    """``file_no``, ``field``, the variant ``_v`` and the number as written ``_raw`` of each top-level field of each line."""
    fields, raw = _parsed(F.col("body"), False)
    rows = lines.select(F.col("file_no").cast("bigint").alias("file_no"), fields.alias("_m"), raw.alias("_raw"))
    return rows.select("file_no", "_raw", F.posexplode("_m").alias("_n", "field", "_v")).select("file_no", "field", "_v", F.get("_raw", F.col("_n")).alias("_raw"))


def file_fields(lines: DataFrame) -> DataFrame:
    """``file_no``, ``field``, ``types``, ``n_lines``: one row for each file and field, fused."""
    cells = _values(lines).select("file_no", "field", "_raw", F.schema_of_variant("_v").alias("_s"))
    kind, wide = _kind(F.col("_s"), F.col("_raw"))
    cells = cells.select("file_no", "field", kind.alias("k"), wide.alias("wide"))
    bits = F.coalesce(F.expr("shiftleft(1, k)"), F.lit(0)) + F.when(F.col("wide"), WIDE).otherwise(0)
    return cells.groupBy("file_no", "field").agg(F.bit_or(bits).alias("types"), F.count("*").alias("n_lines"))


def value_shapes(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``file_no``, ``field`` and the ``shapes`` of the values that the field has in the file ``source``, for each row of ``wanted``: file_no,
    field, source.  Only lines of such files are read again."""
    files = wanted.select(F.col("source").alias("file_no")).distinct()
    keyed = lines.select(F.col("file_no").cast("bigint").alias("file_no"), "body")
    cells = _values(sized_join(keyed, files, ["file_no"], "left_semi")).withColumnRenamed("file_no", "source")
    cells = sized_join(cells, wanted, ["source", "field"]).select("file_no", "field", "_raw", F.schema_of_variant("_v").alias("_s"), F.to_json("_v").alias("_j"))
    kind, _ = _kind(F.col("_s"), F.col("_raw"))
    cells = cells.select("file_no", "field", kind.alias("k"), _text(kind, F.col("_j"), F.col("_raw")).alias("t"))
    scalar = F.when(F.col("k") == 0, _text_shape(F.col("t"))).when(F.col("k") == 3, "boolean").when(F.col("k").isNotNull(), _number_shape(F.col("t")))
    shapes = F.when(F.col("k") >= 4, _inner_shapes(F.col("t"))).when(F.col("k").isNotNull(), F.array(F.xxhash64(scalar)))
    # by shape first: that is combined before the shuffle in a fixed space
    one = cells.select("file_no", "field", F.explode(shapes).alias("shape")).distinct()
    return one.groupBy("file_no", "field").agg(F.collect_set("shape").alias("shapes"))


def names_by_use(fields: DataFrame) -> list[tuple[str, int, int]]:
    """Name, lines and files of the ``MOST_NAMES`` most used names."""
    n = fields.groupBy("field").agg(F.sum("n_lines").alias("n"), F.count("*").alias("files"))
    return [(r.field, r.n, r.files) for r in n.orderBy(F.desc("n"), "field").limit(MOST_NAMES).collect()]


def learn(fields: DataFrame, names: list[tuple[str, int, int]]) -> Learned:
    """Different fields and exclusive words, from which of the most used names stand side by side in files.

    Only pairs of names that share a word are looked at; files are reduced to different sets of such names first.
    """
    spark, files = fields.sparkSession, {n: k for n, _, k in names}
    by_word: dict[str, list[str]] = defaultdict(list)
    for n in files:
        for w in name_words(n):
            by_word[w[:3]].append(n)
    pairs = sorted({(a, b) for group in by_word.values() for a in group for b in group if a < b})
    if not pairs:
        return Learned()
    known = F.broadcast(spark.createDataFrame([(n,) for n in files], "field string"))
    sets = fields.join(known, "field").groupBy("file_no").agg(F.sort_array(F.collect_set("field")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    of = F.broadcast(spark.createDataFrame(pairs, "a string, b string"))
    both = sets.select("s", "n", F.explode("s").alias("a")).join(of, "a").where(F.array_contains("s", F.col("b"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    apart = [(r.a, r.b) for r in both.collect() if r.n >= SIDE_BY_SIDE * min(files[r.a], files[r.b])]
    words = (_split_words(a, b)[1:] for a, b in apart)
    return Learned(frozenset(map(frozenset, apart)), frozenset(frozenset((x[0], y[0])) for x, y in words if len(x) == len(y) == 1))


def _word_pairs(renames: DataFrame) -> list[tuple[str, str, int]]:
    """Pairs of words that take each other's place in renames of more than one file, most often first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for old, new, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shared, left, right = _split_words(old, new)
                if shared and len(left) == len(right) == 1:
                    rows.append((*sorted((left[0], right[0])), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["x", "y", "n"])

    pairs = renames.groupBy("old", "new").agg(F.count("*").alias("n")).mapInArrow(run, "x string, y string, n bigint")
    found = pairs.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1").collect()
    return sorted(((r.x, r.y, r.n) for r in found), key=lambda r: (-r[2], r[:2]))


def _joined(pairs: list[tuple[str, str, int]], learned: Learned) -> Learned:
    """``learned`` with one word for all words that are linked by ``pairs`` and do not exclude each other."""
    group: dict[str, set[str]] = {}
    for x, y, _ in pairs:
        a, b = group.setdefault(x, {x}), group.setdefault(y, {y})
        if a is not b and not any(frozenset((v, w)) in learned.exclusive for v in a for w in b):
            a |= b
            for w in b:
                group[w] = a
    same = {w: min(g) for w, g in group.items()}
    return Learned(learned.different, frozenset(frozenset(same.get(w, w) for w in pair) for pair in learned.exclusive), same)


def with_synonyms(learned: Learned, renames: DataFrame) -> Learned:
    """``learned`` and the words that take each other's place in renames of more than one file, unless they exclude each other."""
    return _joined(_word_pairs(renames), learned)


def file_order(lines: DataFrame) -> DataFrame:
    """``file_no`` and ``before``, the file before it in its stream by written_at, then file_no; null for the first.

    A stream may hold most files: files in order of stream and time are cut into ranges, and a range's first file follows
    the last one of the range before if that is of the same stream.
    """
    files = lines.groupBy("file_no").agg(F.min("stream").alias("stream"), F.min("written_at").alias("written_at"))
    files = in_ranges(files.withColumn("_s", F.struct("stream")), ["_s", F.asc_nulls_first("written_at"), "file_no"], RANGE_FILES)
    place = F.struct("_s", "written_at", "file_no")
    # one row for each range
    last = files.groupBy("_range").agg(F.max(place).alias("_last")).withColumn("_last", F.lag("_last").over(Window.orderBy("_range")))
    within = Window.partitionBy("_range").orderBy("_s", F.asc_nulls_first("written_at"), "file_no")
    files = files.withColumn("_prev", F.lag(place).over(within))
    files = sized_join(files, last, ["_range"], "left").withColumn("_prev", F.coalesce("_prev", "_last"))
    return files.select("file_no", F.when(F.col("_prev._s") == F.col("_s"), F.col("_prev.file_no")).alias("before"))


def match_renames(gone: list[tuple[str, set]], come: list[tuple[str, set]], learned: Learned = Learned()) -> list[tuple[str, str]]:
    """Pairs of an old and a new name of the same meaning, best first, each name once.

    ``gone`` and ``come`` hold names with the shapes of their values; a field without values fits any shape.
    """
    ranked = sorted(
        (-score, a, b)
        for a, sa in gone
        for b, sb in come
        if (not sa or not sb or sa & sb) and (score := same_meaning(a, b, learned))
    )
    return _each_once(ranked)


def _each_once(ranked: list[tuple[float, str, str]]) -> list[tuple[str, str]]:
    used_a, used_b, out = set(), set(), []
    for _, a, b in ranked:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return out


def _both_sides(moved: DataFrame) -> DataFrame:
    """``file_no`` and the fields that go and that come with their shapes; ``moved``: file_no, field, is_in, shapes."""
    side = lambda present: F.collect_list(F.when(present, F.struct("field", "shapes")))
    return moved.groupBy("file_no").agg(side(~F.col("is_in")).alias("gone"), side(F.col("is_in")).alias("come")).select("file_no", "gone", "come")


def _renames(moved: DataFrame, learned: Learned) -> DataFrame:
    """``file_no``, ``old``, ``new`` of files in which fields both go and come; ``moved``: file_no, field, is_in, shapes."""
    both = _both_sides(moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (f, a, b)
                for f, gone, come in zip(*(batch.column(k).to_pylist() for k in range(3)))
                for a, b in match_renames(*([(x["field"], set(x["shapes"] or ())) for x in side] for side in (gone, come)), learned)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["file_no", "old", "new"]
            )

    return both.mapInArrow(run, "file_no bigint, old string, new string")


def _candidates(moved: DataFrame, same: dict[str, str]) -> DataFrame:
    """``file_no``, ``old``, ``new``, ``score`` and the words in which the names differ, ``x`` and ``y``: all that can be renames by names and shapes
    alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file_no", "old", "new", "score", "x", "y"])
        rows = []
        for batch in batches:
            for f, gone, come in zip(*(batch.column(k).to_pylist() for k in range(3))):
                gone, come = ([(x["field"], set(x["shapes"] or ())) for x in side] for side in (gone, come))
                for a, sa in gone:
                    for b, sb in come:
                        if (not sa or not sb or sa & sb) and (score := same_meaning(a, b, Learned(same=same))):
                            rows.append((f, a, b, score, *_split_words(a, b, same)[1:]))
                    if len(rows) >= 10_000:
                        yield as_batch(rows)
                        rows = []
        yield as_batch(rows)

    return _both_sides(moved).mapInArrow(run, "file_no bigint, old string, new string, score double, x array<string>, y array<string>")


def _best(candidates: DataFrame) -> DataFrame:
    """``file_no``, ``old``, ``new``: the best candidates of each file, each name once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *pair) for f, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for pair in _each_once(sorted((-c["score"], c["old"], c["new"]) for c in own))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["file_no", "old", "new"])

    own = candidates.groupBy("file_no").agg(F.collect_list(F.struct("score", "old", "new")).alias("own")).select("file_no", "own")
    return own.mapInArrow(run, "file_no bigint, old string, new string")


class _ByJoins:
    """What ``learn`` finds, for any number of names: only what is asked, by joins that leave everything on the executors."""

    def __init__(self, fields: DataFrame) -> None:
        sets = fields.groupBy("file_no").agg(F.sort_array(F.collect_set("field")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        self.in_sets = cut(cut(sets.withColumn("sid", F.monotonically_increasing_id())).select("sid", "n", F.explode("s").alias("field")))
        self.files = cut(self.in_sets.groupBy("field").agg(F.sum("n").alias("files")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(n, w) for n in batch.column(0).to_pylist() for w in name_words(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["field", "word"])

        self.words = cut(self.files.select("field").mapInArrow(run, "field string, word string"))

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b and n, the files that have both) that stand side by side in the least share of files."""
        of = lambda c: self.files.select(F.col("field").alias(c), F.col("files").alias(f"files_{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(F.col("n") >= F.lit(SIDE_BY_SIDE) * F.least("files_a", "files_b"))

    def different(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs of names ``a``, ``b`` that are different fields."""
        left = pairs.join(self.in_sets.withColumnRenamed("field", "a"), "a")
        both = left.join(self.in_sets.select("sid", F.col("field").alias("b")), ["sid", "b"])
        return self._apart(both.groupBy("a", "b").agg(F.sum("n").alias("n"))).select("a", "b")

    def exclusive(self, words: DataFrame) -> DataFrame:
        """``x``, ``y`` and the reverse: which of the ``words`` (word) exclude each other."""
        asked = self.in_sets.join(self.words.join(words.distinct(), "word", "left_semi"), "field")
        left = asked.select("sid", "n", F.col("field").alias("a"), F.col("word").alias("x"))
        right = asked.select("sid", F.col("field").alias("b"), F.col("word").alias("y"))
        both = left.join(right, "sid").where("a < b and x <> y").groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    if _split_words(a, b)[1:] == ([x], [y]) and {w[:3] for w in name_words(a)} & {w[:3] for w in name_words(b)}:
                        rows += [(x, y), (y, x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["x", "y"])

        return self._apart(both).select("a", "b", "x", "y").mapInArrow(run, "x string, y string").distinct()

    def allowed(self, candidates: DataFrame, same: dict[str, str]) -> DataFrame:
        """The candidates that are neither different fields nor differ in words that exclude each other."""
        spark = candidates.sparkSession
        names = cut(candidates.select("old", "new", "x", "y").distinct())
        parted = self.different(names.select(F.col("old").alias("a"), F.col("new").alias("b"))).select(F.col("a").alias("old"), F.col("b").alias("new"))
        words = cut(names.select("old", "new", F.explode("x").alias("x"), "y").select("old", "new", "x", F.explode("y").alias("y")))
        one = spark.createDataFrame(list(same.items()), "word string, one string")
        asked = words.select(F.explode(F.array("x", "y")).alias("one")).distinct()
        # words that stand for a word that is asked are asked, too
        exclusive = self.exclusive(asked.select(F.col("one").alias("word")).union(one.join(asked, "one", "left_semi").select("word")))
        for c in ("x", "y"):
            exclusive = exclusive.join(one.withColumnRenamed("word", c), c, "left").withColumn(c, F.coalesce("one", c)).drop("one")
        barred = words.join(exclusive.distinct(), ["x", "y"], "left_semi").select("old", "new")
        return candidates.join(cut(parted.union(barred).distinct()), ["old", "new"], "left_anti")

    def renames(self, moved: DataFrame) -> DataFrame:
        """``file_no``, ``old``, ``new``, as ``_renames`` gives with what ``learn`` and ``with_synonyms`` find over all names."""
        pairs = _word_pairs(cut(_best(self.allowed(cut(_candidates(moved, {})), {}))))
        asked = moved.sparkSession.createDataFrame([(w,) for r in pairs for w in r[:2]], "word string")
        exclusive = frozenset(frozenset((r.x, r.y)) for r in self.exclusive(asked).where("x < y").collect()) if pairs else frozenset()
        same = _joined(pairs, Learned(exclusive=exclusive)).same
        return _best(self.allowed(cut(_candidates(moved, same)), same))


def compared(lines: DataFrame, fields: DataFrame, names: list[tuple[str, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Each file's fields beside those of the file before it, and the renames among them."""
    order = cut(file_order(lines).where(F.col("before").isNotNull()))
    now = fields.join(order.select("file_no"), "file_no").select("file_no", "field", F.lit(True).alias("now"), "types")
    then = fields.withColumnRenamed("file_no", "before").join(order, "before").select("file_no", "field", F.lit(False).alias("now"), "types")
    plain = F.col("types").bitwiseAND(WIDE - 1)
    both = now.unionByName(then).groupBy("file_no", "field").agg(
        F.bool_or("now").alias("is_in"), F.bool_or(~F.col("now")).alias("was_in"),
        F.coalesce(F.bit_or(F.when(F.col("now"), plain)), F.lit(0)).alias("types_now"),
        F.coalesce(F.bit_or(F.when(~F.col("now"), plain)), F.lit(0)).alias("types_then"),
    )
    changed = cut(both.where((F.col("is_in") != F.col("was_in")) | (F.col("types_now") != F.col("types_then"))))
    # a rename needs a field that goes and one that comes; a field that goes has its values in the file before
    moved = changed.where(F.col("is_in") != F.col("was_in")).select("file_no", "field", "is_in")
    files = moved.groupBy("file_no").agg(F.bool_or("is_in").alias("a"), F.bool_or(~F.col("is_in")).alias("b")).where("a and b").select("file_no")
    moved = cut(moved.join(files, "file_no").join(order, "file_no").withColumn("source", F.when(F.col("is_in"), F.col("file_no")).otherwise(F.col("before"))))
    moved = cut(moved.join(value_shapes(lines, moved.select("file_no", "field", "source")), ["file_no", "field"], "left").select("file_no", "field", "is_in", "shapes"))
    if len(names) >= MOST_NAMES:
        return changed, cut(_ByJoins(fields).renames(moved))
    learned = learn(fields, names)
    return changed, cut(_renames(moved, with_synonyms(learned, cut(_renames(moved, learned)))))


def changes(lines: DataFrame) -> DataFrame:
    """``file_no``, ``change`` and ``field``: every field added, removed, renamed or retyped against the file before.

    ``lines``: file_no, stream, written_at, body.  A renamed field is neither added nor removed; its type is compared
    with that of its old name.  A field without non-null values in either file is not retyped.  Bodies that are no JSON
    object have no field, repeated lines change nothing, a null stream is a stream; a file with a null written_at
    comes first in its stream.
    """
    fields = cut(file_fields(lines))
    changed, renames = compared(lines, fields, names_by_use(fields))
    differs = (F.col("types_now") != 0) & (F.col("types_then") != 0) & (F.col("types_now") != F.col("types_then"))
    kept = changed.where(F.col("is_in") & F.col("was_in") & differs).select("file_no", F.lit("retyped").alias("change"), "field")
    moved = renames.select("file_no", F.lit("renamed").alias("change"), F.col("new").alias("field"))
    old = changed.select("file_no", F.col("field").alias("old"), "types_then")
    new = changed.select("file_no", F.col("field").alias("new"), "types_now")
    retyped = renames.join(old, ["file_no", "old"]).join(new, ["file_no", "new"]).where(differs).select("file_no", F.lit("retyped").alias("change"), F.col("new").alias("field"))
    named = renames.select("file_no", F.explode(F.array("old", "new")).alias("field"))
    plain = changed.where(F.col("is_in") != F.col("was_in")).join(named, ["file_no", "field"], "left_anti")
    plain = plain.select("file_no", F.when(F.col("is_in"), "added").otherwise("removed").alias("change"), "field")
    return plain.unionByName(moved).unionByName(retyped).unionByName(kept)


def _mask_types(mask: Column) -> Column:
    return F.filter(F.array(*(F.when(mask.bitwiseAND(1 << k) != 0, F.lit(t)) for k, t in enumerate(TYPES))), lambda x: x.isNotNull())


def components(pairs: DataFrame) -> DataFrame:
    """``field`` and ``root``, the least name of all that are linked by pairs ``u``, ``v``, for each name in them.

    Links go to the least neighbour, from greater names and from lesser ones in turn, so long chains get short in few rounds.
    """
    edges, before = cut(pairs.where("u <> v").distinct()), None
    while True:
        size = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if size == before:
            return edges.select(F.col("u").alias("field"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").union(least.select("u", "m"))
        edges, before = cut(small.toDF("u", "v").distinct()), size


def one_names(fields: DataFrame, renames: DataFrame) -> DataFrame:
    """``field``, ``one`` and ``n``, its lines: one name for all names that a field has had.

    Names linked by renames are one field, under the most used name; names that are in no rename are not in it.
    """
    pairs = cut(renames.select(F.col("old").alias("u"), F.col("new").alias("v")).distinct())
    if size_of(pairs)[1] <= scale.BROADCAST_BYTES:
        up: dict[str, str] = {}

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for r in pairs.collect():
            up[find(r.u)] = find(r.v)
        roots = pairs.sparkSession.createDataFrame([(x, find(x)) for x in list(up)], "field string, root string")
    else:
        roots = components(pairs)
    used = sized_join(fields.groupBy("field").agg(F.sum("n_lines").alias("n")), roots, ["field"])
    used = cut(used)
    best = used.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "field"))["field"].alias("one"))
    return cut(used.join(best, "root").select("field", "one", "n"))


def _paths(lines: DataFrame) -> DataFrame:
    """``file_no``, ``field``, ``inner``, ``types``, ``n_lines``: fields with the types at every path inside them (``.key`` and ``[]``), level by
    level, as deep as bodies go."""
    v = F.explode(F.from_json("body", "map<string,variant>", {"allowSingleQuotes": "false"})).alias("field", "v")
    level, out = lines.select(F.col("file_no").cast("bigint").alias("file_no"), v).withColumn("inner", F.lit("")), []
    text = F.to_json("v")
    nested = text.rlike(r"^[\[{]")
    while True:
        inside = cut(level.where(nested).select("file_no", "field", "inner", "v"))
        if not inside.limit(1).count():
            break
        level = inside.lateralJoin(inside.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
            "file_no", "field", F.concat("inner", F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), "key"))).alias("inner"), F.col("value").alias("v")
        )
        kind = F.schema_of_variant("v")
        bit = (
            F.when(kind == "VOID", 0).when(kind == "STRING", 1).when(kind.rlike(r"^BIGINT|^DECIMAL\((19|[23][0-9]),0\)"), 2).when(kind.rlike("^DECIMAL|^DOUBLE|^FLOAT"), 4)
            .when(kind == "BOOLEAN", 8).when(kind.startswith("ARRAY"), 16).otherwise(32)
        )
        out.append(level.groupBy("file_no", "field", "inner").agg(F.bit_or(bit).alias("types"), F.count("*").alias("n_lines")))
    empty = lines.sparkSession.createDataFrame([], "file_no bigint, field string, inner string, types int, n_lines bigint")
    for x in out:
        empty = empty.unionByName(x)
    return empty


def alternatives(lines: DataFrame) -> DataFrame:
    """``field``, ``names``, ``types``, ``n_lines`` and ``first_file``: the fused schema with every alternative type at every path.

    ``field`` is the one name, followed by the path inside it for nested values; ``names`` are the names it has had; ``n_lines``
    counts values, of which a line can have several inside arrays.
    """
    fields = cut(file_fields(lines))
    table = one_names(fields, compared(lines, fields, names_by_use(fields))[1]).select("field", "one")
    plain = F.col("types").bitwiseAND(WIDE - 1).alias("types")
    all_paths = fields.select("file_no", "field", F.lit("").alias("inner"), plain, "n_lines").unionByName(_paths(lines))
    fused = sized_join(all_paths, table, ["field"], "left").groupBy(F.concat(F.coalesce("one", "field"), "inner").alias("field")).agg(
        F.sort_array(F.collect_set("field")).alias("names"), F.bit_or("types").alias("_t"), F.sum("n_lines").alias("n_lines"), F.min("file_no").alias("first_file")
    )
    return fused.select("field", "names", _mask_types(F.col("_t")).alias("types"), "n_lines", "first_file")


def one_table(lines: DataFrame) -> DataFrame:
    """All lines in one table: a column for each field under its one name.

    A field of one type has that type (arrays and objects as JSON text).  A field with several, or with numbers beyond 64
    bits, has its values as text (``field``, the canonical conversion) and a typed branch for each alternative
    (``field__whole`` and so on), null where the value is of another type.  Where a body has several values for a field,
    under other names of it or under a repeated key, the most used name's first value is taken and the others stand in
    ``_conflicts`` with their names.  The ``MOST_NAMES`` most used names have columns, with the values of every rarer name
    of their fields; all other fields are kept in ``_rest``, by name.
    """
    fields = cut(file_fields(lines))
    names = names_by_use(fields)
    linked = one_names(fields, compared(lines, fields, names)[1])
    known = F.broadcast(lines.sparkSession.createDataFrame([(n,) for n, _, _ in names], "field string"))
    one = {n: n for n, _, _ in names} | {r.field: r.one for r in linked.join(known, "field").collect()}
    columns = F.broadcast(lines.sparkSession.createDataFrame([(n,) for n in set(one.values())], "one string"))
    # rarer names of the fields that have columns
    rarer = cut(linked.join(columns, "one", "left_semi").join(known, "field", "left_anti")) if len(names) >= MOST_NAMES else None
    own = sized_join(fields, linked.select("field", "one"), ["field"], "left").select(F.coalesce("one", "field").alias("one"), "types")
    masks = {r.one: r.t for r in own.join(columns, "one").groupBy("one").agg(F.bit_or("types").alias("t")).collect()}
    head = ["file_no", "stream", "written_at", "line_no"]

    parsed, raw = _parsed(F.col("body"), True)
    entry = lambda e, n: F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("j"), F.schema_of_variant(e["value"]).alias("s"), F.get("_raw", n).alias("raw"))

    def cell(e: Column) -> Column:
        kind, _ = _kind(e["s"], e["raw"])
        return F.struct(e["name"].alias("name"), kind.alias("k"), _text(kind, e["j"], e["raw"]).alias("t"))

    some = F.filter(F.transform("_e", cell), lambda x: x["k"].isNotNull())
    groups: dict[str, list[str]] = {}
    for n, _, _ in names:
        groups.setdefault(one[n], []).append(n)
    types = ("string", "bigint", "double", "boolean", "string", "string")
    wide_types = ("string", "decimal(38,0)", "double", "boolean", "string", "string")
    first, out, others = [], [], []
    for n, field in enumerate(sorted(masks)):
        # names stand in order of use, so the most used name's value is first
        own = [_named(m) for m in groups[field]]
        if rarer is not None:
            own.append(F.transform(F.filter("_more", lambda x: x["one"] == field), lambda x: x["cell"]))  # noqa: B023
        cells = F.concat(*own) if len(own) > 1 else own[0]
        first.append(cells.alias(f"_{n}"))
        cell = F.get(F.col(f"_{n}"), F.lit(0))
        present = [k for k in range(len(TYPES)) if masks[field] >> k & 1]
        shown = field if field not in (*head, "_conflicts", "_rest") else f"{field}_"
        others.append(_beyond_first(n, field))
        if len(present) == 1 and masks[field] < WIDE:
            out.append(cell["t"].try_cast(types[present[0]]).alias(shown))
            continue
        out.append(cell["t"].alias(shown))
        of = wide_types if masks[field] >= WIDE else types
        out += [F.when(cell["k"] == k, cell["t"]).try_cast(of[k]).alias(f"{shown}__{TYPES[k]}") for k in present]
    conflict = F.array().cast("array<struct<field:string,name:string,value:string>>")
    conflicts = F.concat(conflict, *others)
    rest = F.filter("_c", lambda x: ~x["name"].isin(list(one)) if one else F.lit(True))
    if rarer is not None:
        rest = F.filter(rest, lambda x: ~F.array_contains(F.transform("_more", lambda m: m["cell"]["name"]), x["name"]))
    rest = F.transform(rest, lambda x: F.struct(x["name"].alias("name"), x["t"].alias("value")))
    rows = lines.select(*head, parsed.alias("_m"), raw.alias("_raw")).select(*head, F.transform(F.map_entries("_m"), entry).alias("_e")).select(*head, F.coalesce(some, F.array().cast(CELLS)).alias("_c"))
    if rarer is not None:
        rows = _with_rarer(rows, rarer)
    rows = rows.select("*", *first)
    return rows.select(*head, *out, F.when(F.size(conflicts) > 0, conflicts).alias("_conflicts"), F.when(F.size(rest) > 0, rest).alias("_rest"))


def _with_rarer(rows: DataFrame, rarer: DataFrame) -> DataFrame:
    """``rows`` and ``_more``: their cells under rarer names of fields that have columns, as ``one`` and ``cell``, in order of use."""
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    cells = rows.select("_id", F.posexplode("_c").alias("_at", "cell")).withColumn("field", F.col("cell.name"))
    found = sized_join(cells, rarer, ["field"]).groupBy("_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "field", "_at", "one", "cell"))).alias("_more"))
    found = found.select("_id", F.transform("_more", lambda x: F.struct(x["one"].alias("one"), x["cell"].alias("cell"))).alias("_more"))
    none = F.array().cast(f"array<struct<one:string,cell:{CELLS[6:-1]}>>")
    return rows.join(found, "_id", "left").withColumn("_more", F.coalesce("_more", none)).drop("_id")


def _named(name: str) -> Column:
    return F.filter("_c", lambda x: x["name"] == name)


def _beyond_first(n: int, field: str) -> Column:
    more = F.slice(F.col(f"_{n}"), F.lit(2), F.greatest(F.size(f"_{n}"), F.lit(1)))
    return F.transform(more, lambda x: F.struct(F.lit(field).alias("field"), x["name"].alias("name"), x["t"].alias("value")))

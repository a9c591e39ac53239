"""One form for text that looks the same.

Code points and strings that look alike are joined to classes by union-find: full-width and ordinary forms, composed
letters and letters with combining accents, kinds of space, invisible characters (alike to the empty string) and
letters of other scripts that look like Latin ones.  The relations come from the Unicode character database of Python
and the confusables of the ICU library that comes with Spark; none is typed in here.  The most frequent member in the
corpus stands for its class, and a multi-pattern automaton rewrites every text greedily, longest match first.

What stays different: case, accents, digits (raised ones, too), ligatures and signs, tabs and line ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import cut, sized_join

#: Format characters that are drawn, and characters outside that category that are not.
DRAWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
NOT_DRAWN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
#: Fixed value: a space that is drawn.
DRAWN_SPACE = 0x1680

_ASCII = bytes(range(128))
_ODD = re.compile("[^\x00-\x7f]+").finditer


class UnionFind:
    """Classes of strings; joining is transitive."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for _, v in sorted(out.items()) if len(v) > 1]


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def letters_alike(spark: SparkSession) -> list[tuple[str, str]]:
    """Letters of different scripts that look alike, of the same case, as pairs with the one that stands for them.

    Letters look alike if ICU gives them the same skeleton.  The Latin letter stands for the others, where there is one, else the
    one with the smallest code point.  A skeleton stands for several Latin signs at times (``l`` for l, I, 1 and |), so letters
    are told apart by case; letters of a script without case join the case that the skeleton itself has.  Digits and signs are
    left out, as are letters that compatibility forms or raised letters are made of.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    others = [
        c for c in map(chr, (*range(0x370, 0x1D00), *range(0x1E00, 0xAC00), *range(0x10000, 0x12000), *range(0x16800, 0x17000), *range(0x1E900, 0x1E960)))
        if unicodedata.category(c) in ("Lu", "Ll", "Lo") and _script(c) not in ("", "LATIN") and unicodedata.normalize("NFKD", c) == c
    ]
    skeleton = dict(zip([*latin, *others], checker.getSkeleton("\n".join([*latin, *others])).split("\n")))
    groups: dict[tuple[str, bool], list[str]] = {}
    for c in [*latin, *others]:
        if unicodedata.category(c) != "Lo":
            groups.setdefault((skeleton[c], c.isupper()), []).append(c)
    for c in others:
        if unicodedata.category(c) == "Lo":
            s = skeleton[c]
            known = [(s, upper) for upper in (s.isupper(), not s.isupper()) if (s, upper) in groups]
            groups.setdefault(known[0] if known else (s, False), []).append(c)
    return [(c, group[0]) for group in groups.values() for c in group[1:] if _script(c) != _script(group[0])]


def _width(c: str) -> str | None:
    tag, _, codes = unicodedata.decomposition(c).partition(" ")
    return "".join(chr(int(x, 16)) for x in codes.split()) if tag in ("<wide>", "<narrow>") else None


def alike_classes(letters: list[tuple[str, str]]) -> list[list[str]]:
    """All look-alike classes, each a sorted list of strings; the empty string is in the class of what is not drawn."""
    uf = UnionFind()
    composed: list[tuple[str, str]] = []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cn" or kind == "Co":
            continue
        if code in NOT_DRAWN or kind == "Cf" and code not in DRAWN_FORMATS or 0xE0100 <= code < 0xE01F0:
            uf.join(c, "")
        elif kind == "Zs" and code != DRAWN_SPACE:
            uf.join(c, " ")
        elif plain := _width(c):
            uf.join(c, plain)
        elif not 0xAC00 <= code < 0xD7A4 and (apart := unicodedata.normalize("NFD", c)) != c:
            composed.append((c, apart))
    for a, b in letters:
        uf.join(a, b)
    members: dict[str, list[str]] = {}
    for x in list(uf.up):
        if len(x) == 1:
            members.setdefault(uf.find(x), []).append(x)
    for c, apart in composed:
        base, marks = apart[0], apart[1:]
        uf.join(c, apart)
        if base in uf.up:
            for other in members.get(uf.find(base), []):
                uf.join(other + marks, apart)
    return uf.classes()


def representatives(classes: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Each member that is not the representative of its class, with the representative.

    The representative is the most frequent member; a string is as frequent as its rarest code point, and the
    shorter, then smaller one wins a tie.  The empty string stands for what is not drawn.
    """
    out: dict[str, str] = {}
    for members in classes:
        if "" in members:
            best = ""
        else:
            best = min(members, key=lambda m: (-min(counts.get(c, 0) for c in m), len(m), m))
        out |= {m: best for m in members if m != best}
    return out


class Rewriter:
    """Brings texts to one form with the rewriting rules of ``representatives``."""

    def __init__(self, rules: dict[str, str]):
        self.erase = self._automaton({a: b for a, b in rules.items() if b == ""})
        self.change = self._automaton({a: b for a, b in rules.items() if b != ""})
        self.plain_ascii = not any(a.isascii() for a in rules)
        self.touched = {c for a in rules for c in a if not c.isascii()}
        self.safe: set[str] = set()
        self.seen: dict[int, dict[str, str]] = {}

    @staticmethod
    def _automaton(rules: dict[str, str]) -> ahocorasick.Automaton | None:
        if not rules:
            return None
        out = ahocorasick.Automaton()
        for a, b in rules.items():
            out.add_word(a, (len(a), b))
        out.make_automaton()
        return out

    @staticmethod
    def _apply(automaton, text: str) -> str:
        if automaton is None:
            return text
        out, last = [], 0
        for end, (size, b) in automaton.iter_long(text):
            start = end + 1 - size
            if start > last:
                out.append(text[last:start])
            out.append(b)
            last = end + 1
        if not last:
            return text
        out.append(text[last:])
        return "".join(out)

    def _stays(self, text: str) -> bool:
        """Whether no sign of the text takes part in a rule or in composition."""
        if not self.plain_ascii:
            return False
        if text.isascii():
            return True
        rest = text.encode("utf-8", "surrogatepass").translate(None, _ASCII).decode("utf-8", "surrogatepass")
        for c in set(rest) - self.safe:
            if c in self.touched or unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) < 0x1200 or unicodedata.normalize("NFC", c) != c:
                return False
            self.safe.add(c)
        return True

    def _spans(self, automaton, text: str) -> str:
        """``_apply`` on the spans in which a match can lie: runs outside ASCII, with the sign before a leading mark."""
        if automaton is None:
            return text
        if not self.plain_ascii:
            return self._apply(automaton, text)
        seen = self.seen.setdefault(id(automaton), {})
        out, last = [], 0
        for m in _ODD(text):
            start, end = m.span()
            if start > last and text[start] in self.touched and unicodedata.category(text[start])[0] == "M":
                start -= 1
            span = text[start:end]
            new = seen.get(span)
            if new is None:
                new = self._apply(automaton, span)
                if len(seen) > 200_000:
                    seen.clear()
                if len(span) <= 32:
                    seen[span] = new
            if new != span:
                out += (text[last:start], new)
                last = end
        if not last:
            return text
        out.append(text[last:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self._stays(text):
            return text
        text = unicodedata.normalize("NFC", self._spans(self.erase, text))
        return unicodedata.normalize("NFC", self._spans(self.change, text))


def code_point_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``sign`` (a code point as text) and ``n``, its count over all texts; at most one row for each code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = "".join(t for t in batch.column(0).slice(start, 2_000).to_pylist() if t)
                whole = part.encode("utf-8", "surrogatepass")
                total[:128] += np.bincount(np.frombuffer(whole, np.uint8), minlength=256)[:128]
                odd = whole.translate(None, _ASCII).decode("utf-8", "surrogatepass")
                if odd:
                    n = np.bincount(np.frombuffer(odd.encode("utf-32-le", "surrogatepass"), np.uint32))
                    total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in seen], pa.string()), pa.array(total[seen])], names=["sign", "n"])

    return df.select(text).mapInArrow(run, "sign string, n bigint").groupBy("sign").agg(F.sum("n").alias("n"))


def corpus_rules(df: DataFrame, text: str = "text") -> dict[str, str]:
    """The rewriting rules for a corpus: classes from public tables, representatives by frequency in all texts.

    What comes to the driver is at most one count for each code point in some class, a few thousand.
    """
    classes = alike_classes(letters_alike(df.sparkSession))
    signs = sorted({c for members in classes for m in members for c in m})
    wanted = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in signs], "sign string"))
    counts = {r.sign: r.n for r in code_point_counts(df, text).join(wanted, "sign").collect()}
    return representatives(classes, counts)


def one_form(df: DataFrame, rules: dict[str, str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column`` and ``text`` in one form; a null text stays null, an empty one empty."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(rules.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(dict(shared.value))
        for batch in batches:
            out = [None if t is None else rewrite(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_column)


def form_hashes(df: DataFrame, rules: dict[str, str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``form`` and ``own``: 128-bit hashes of the text in one form and as it is.

    Null, empty and blank texts (nothing drawn but white space) are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(sorted(rules.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(dict(shared.value))
        for batch in batches:
            ids, forms, owns = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                form = rewrite(t)
                if not form.strip():
                    continue
                own = blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                ids.append(i)
                owns.append(own)
                forms.append(own if form == t else blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of), pa.array(forms, pa.binary()), pa.array(owns, pa.binary())], names=["_id", "form", "own"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(df.schema[id_column].dataType)
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_id {df.schema[id_column].dataType.simpleString()}, form binary, own binary").withColumnRenamed("_id", id_column)


def _chunks(count: Column, size: int) -> Column:
    return F.ceil(count / F.lit(size)).cast("int")


def alike_pairs(hashes: DataFrame, id_column: str = "doc_id", chunk: int = 1_000) -> DataFrame:
    """``doc_id_a``, ``doc_id_b``: all pairs of different texts with the same form, the smaller id first.

    Different texts are paired first, so copies of one text are never held against each other; then each side gets its
    documents.  The texts of a form, and the documents of a text, are cut into chunks by their counts, and a task's share of
    the pairs is a pair of chunks, however many a form or a text has.
    """
    hashes = cut(hashes.select(F.col(id_column).alias("_id"), "form", "own").where(F.col("_id").isNotNull()).distinct())
    several = hashes.groupBy("form").agg(F.min("own").alias("_lo"), F.max("own").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("form")
    rows = cut(sized_join(hashes, several, ["form"], "left_semi"))
    texts = rows.groupBy("form", "own").agg(F.count("*").alias("n"))
    texts = cut(sized_join(texts, texts.groupBy("form").agg(_chunks(F.count("*"), chunk).alias("_k")), ["form"]))
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    place = F.pmod(F.xxhash64("own"), F.col("_k")).cast("int")
    a = texts.select("form", F.col("own").alias("own_a"), F.col("n").alias("_na"), place.alias("_i"), every.alias("_j"))
    b = texts.select("form", F.col("own").alias("own_b"), F.col("n").alias("_nb"), place.alias("_j"), every.alias("_i"))
    pairs = a.join(b, ["form", "_i", "_j"]).where(F.col("own_a") < F.col("own_b"))
    pairs = pairs.select("own_a", "own_b", F.explode(F.sequence(F.lit(0), _chunks(F.col("_na"), chunk) - 1)).alias("_ca"), "_nb")
    pairs = pairs.select("own_a", "own_b", "_ca", F.explode(F.sequence(F.lit(0), _chunks(F.col("_nb"), chunk) - 1)).alias("_cb"))
    documents = sized_join(rows, texts.select("own", "n"), ["own"]).select("_id", "own", F.pmod(F.xxhash64("_id"), _chunks(F.col("n"), chunk)).cast("int").alias("_c"))
    for side in ("a", "b"):
        own = documents.select(F.col("_id").alias(f"_id_{side}"), F.col("own").alias(f"own_{side}"), F.col("_c").alias(f"_c{side}"))
        pairs = pairs.join(own, [f"own_{side}", f"_c{side}"])
    out = pairs.where(F.col("_id_a") != F.col("_id_b"))
    return out.select(F.least("_id_a", "_id_b").alias("doc_id_a"), F.greatest("_id_a", "_id_b").alias("doc_id_b")).distinct()


def form_classes(hashes: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, ``class_id`` (the smallest id with the same form) and ``n_texts``, the different texts of the class."""
    groups = hashes.groupBy("form").agg(F.min(id_column).alias("class_id"), F.countDistinct("own").alias("n_texts"))
    return sized_join(hashes, groups, ["form"]).select(id_column, "class_id", "n_texts")

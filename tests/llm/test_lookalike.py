import unicodedata

import pytest
from pyspark.sql import functions as F

from tessel.llm import lookalike, queries

SAME = [
    ("full-width", "ｆｕｌｌ－ｗｉｄｔｈ"), ("café", "café"), ("café", "cafe​́"), ("a b", "a\xa0b"), ("a b", "a　b"), ("ab", "a​‍b﻿"), ("ab", "a\xadb"), ("pace", "расе"), ("Tom", "Τοm"),
    ("ёлка", "ёлка"), ("ёlk", "ёlk"), ("ệ", "ệ"), ("ệ", "е̣̂"), ("x̣́", "x̣́"), ("ấ", "а̂́"), ("Å", "Å"), ("ガ", "ｶﾞ"), ("각", "각"), ("é", "ｅ́"),
    ("I am", "Ι аm"), ("é̛", "е̛́"),
]
OTHER = [("a", "A"), ("e", "é"), ("2", "²"), ("I", "l"), ("1", "l"), ("O", "0"), ("ﬁ", "fi"), ("a b", "ab"), ("a b", "a  b"), ("a\tb", "a b"), ("a\r\nb", "a\nb"), ("и", "u"), ("ß", "β"), ("З", "3"), ("i", "ı"), ("–", "-"), ("½", "1/2")]


@pytest.fixture(scope="module")
def rewrite(spark):
    letters = lookalike.letters_alike(spark)
    return lookalike.Rewriter(lookalike.representatives(lookalike.alike_classes(letters), {c: 1000 - k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz ")} | {"é": 5}))


@pytest.mark.parametrize(("a", "b"), SAME)
def test_alike(rewrite, a, b):
    assert rewrite(a) == rewrite(b)
    assert rewrite(rewrite(b)) == rewrite(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_not_alike(rewrite, a, b):
    assert rewrite(a) != rewrite(b)


def test_representatives_follow_the_corpus(spark):
    classes = lookalike.alike_classes(lookalike.letters_alike(spark))
    latin = lookalike.Rewriter(lookalike.representatives(classes, {"a": 9, "а": 1}))
    cyrillic = lookalike.Rewriter(lookalike.representatives(classes, {"a": 1, "а": 9}))
    assert latin("а") == "a" and cyrillic("a") == "а" and not cyrillic.plain_ascii
    for x, y in SAME:
        assert cyrillic(x) == cyrillic(y)
    for x, y in OTHER:
        assert cyrillic(x) != cyrillic(y)


def test_union_find_is_transitive():
    uf = lookalike.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "d"), ("x", "y")):
        uf.join(a, b)
    assert uf.classes() == [["a", "b", "c", "d"], ["x", "y"]]


def test_spans_equal_the_plain_automaton(rewrite):
    texts = [a + b + c for a, _ in SAME for _, b in SAME for c in ("", "́", "​́x")]
    plain = lambda t: unicodedata.normalize("NFC", rewrite._apply(rewrite.change, unicodedata.normalize("NFC", rewrite._apply(rewrite.erase, t))))
    assert [rewrite(t) for t in texts] == [plain(t) for t in texts]


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"form": F.lit(1), "own": F.lit(2), "_id": F.lit(3), "sign": F.lit(4)})
    return {tuple(r) for r in lookalike.alike_pairs(lookalike.form_hashes(df, lookalike.corpus_rules(df))).collect()}


def test_pairs(spark):
    rows = [(9, "pace"), (4, "расе"), (5, "pace"), (6, "Pace"), (7, None), (8, ""), (1, " "), (2, "​"), (3, "　"), (10, "расe")]
    assert pairs_of(spark, rows) == {(4, 9), (4, 5), (4, 10), (5, 10), (9, 10)}


def test_many_copies_and_repeated_rows(spark):
    rows = [(k, "same text") for k in range(200)] + [(500, "same\xa0text"), (500, "same\xa0text")]
    assert pairs_of(spark, rows) == {(k, 500) for k in range(200)}


@pytest.mark.parametrize("chunk", [2, 1_000])
def test_pairs_in_chunks(spark, chunk):
    texts = ["a b c d", "a\xa0b c d", "a b\xa0c d", "a b c\xa0d", "a\xa0b\xa0c d", "x y", "x\xa0y", "alone", "alone"]
    rows = [(k, texts[0 if k % 3 == 0 else k % len(texts)]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in lookalike.alike_pairs(lookalike.form_hashes(df, lookalike.corpus_rules(df)), chunk=chunk).collect()]
    plain = lambda t: t.replace("\xa0", " ")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a != b and plain(a) == plain(b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table_and_null_ids(spark):
    assert pairs_of(spark, []) == set()
    assert pairs_of(spark, [(None, "ab"), (1, "a​b")]) == set()


def test_very_long_text(spark):
    a, b = "word café " * 40_000, "word café " * 40_000
    assert pairs_of(spark, [(1, a), (2, b)]) == {(1, 2)}


def test_against_all_pairs_of_the_test_table(spark, sf):
    rules = lookalike.corpus_rules(queries.table(spark, sf, "documents"))
    rewrite = lookalike.Rewriter(rules)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text and rewrite(r.text).strip()]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a != b and rewrite(a) == rewrite(b)}
    assert {tuple(r) for r in queries.p9_found(spark, sf).collect()} == want and want


def test_one_form_and_classes(spark):
    df = spark.createDataFrame([(1, "a\xa0b"), (2, "a b"), (3, None), (4, "")], "doc_id bigint, text string")
    rules = lookalike.corpus_rules(df)
    assert {r.doc_id: r.text for r in lookalike.one_form(df, rules).collect()} == {1: "a b", 2: "a b", 3: None, 4: ""}
    assert {tuple(r) for r in lookalike.form_classes(lookalike.form_hashes(df, rules)).collect()} == {(1, 1, 2), (2, 1, 2)}

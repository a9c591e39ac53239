"""Queries p7 to p9 over the documents of a folder, with production parameters on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import encoding, lookalike, mixing
from .bpe import BpeVocabulary


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(spark, d, "documents"), BpeVocabulary.load("byte_bpe_50k"))


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    return encoding.count_tokens(table(spark, d, "documents"), BpeVocabulary.load("byte_bpe_50k"), ["doc_id", "lang", "source"])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return encoding.count_tokens(table(spark, d, "documents"), BpeVocabulary.load("byte_bpe_50k"), ["doc_id", "source"])


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = mixing.cut(_sized(spark, d)), table(spark, d, "mix_targets")
    return mixing.shares(documents, targets, mixing.mix(documents, targets))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return lookalike.alike_pairs(lookalike.form_hashes(t, lookalike.corpus_rules(t)))


def p9_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return lookalike.one_form(t, lookalike.corpus_rules(t))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return lookalike.form_classes(lookalike.form_hashes(t, lookalike.corpus_rules(t)))


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = lookalike.corpus_rules(table(spark, d, "documents"))
    return spark.createDataFrame(sorted(rules.items()), "member string, representative string").orderBy("member")


QUERIES = {f.__name__: f for f in (p7_ids, p7_lengths, p8_mix, p8_shares, p9_found, p9_text, p9_classes, p9_rules)}
#: None of these can be said in SQL; tests hold them against brute force and the tokenizer's own library.
ORACLES: dict[str, str] = {}

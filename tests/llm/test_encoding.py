import os
import random

import pytest
from pyspark.sql import functions as F

from tessel.llm import encoding, queries
from tessel.llm.bpe import BpeVocabulary, PairIndexEncoder, default_folder

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "\n", "\n\n  x", "Hello world", "don't we'll I'm 'sup", "a" * 20_000, "ab" * 9_999, "aaaa aaa aa a", "Zoë naïve ①②③ ²³ ½", "雨天 грузить первым",
    "👩‍👩‍👧 emoji 🏳️‍🌈", "tabs\tand\r\nlines\r\n\r\n", "  leading   and trailing  ", "x=1;y==2!!!???", "​﻿\xad", "\x00\x01", "<|endoftext|>", "0123456789" * 50, "ﬀ ǅ ß", "퟿",
]


@pytest.fixture(scope="module")
def vocabulary():
    return BpeVocabulary.load("byte_bpe_50k")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(os.path.join(default_folder(), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def expected(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_edge_texts_equal_the_library(spark, vocabulary, library):
    got = {r.doc_id: r.ids for r in encoding.encode_texts(rows_of(spark, TEXTS), vocabulary).collect()}
    assert [got[k] for k in range(len(TEXTS))] == expected(library, TEXTS)


def test_lengths_equal_ids_and_other_columns_are_left_alone(spark, vocabulary, library):
    df = rows_of(spark, TEXTS).withColumns({"ids": F.lit("mine"), "_id": F.lit(1), "n_tokens": F.lit(None), "source": F.lit(None).cast("string")})
    out = encoding.count_tokens(df, vocabulary, ["doc_id", "source"])
    assert out.columns == ["doc_id", "source", "n_tokens"]
    got = {r.doc_id: r.n_tokens for r in out.collect()}
    assert [got[k] for k in range(len(TEXTS))] == [len(x) for x in expected(library, TEXTS)]


def test_every_document_of_the_test_table(spark, sf, library):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, sf).collect()}
    assert got.keys() == documents.keys()
    keys = list(documents)
    assert [got[k] for k in keys] == expected(library, [documents[k] for k in keys])


def test_repeats_null_ids_and_an_empty_table(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id bigint, text string")
    rows = encoding.encode_texts(df, vocabulary).collect()
    assert len(rows) == 3 and len({tuple(r.ids) for r in rows}) == 1
    assert encoding.encode_texts(df.limit(0), vocabulary).collect() == []


def test_chunks_and_forgetting_do_not_change_results(spark, vocabulary, library):
    encoder = encoding.CorpusEncoder(vocabulary)
    dice = random.Random(5)
    texts = ["".join(dice.choice("abcde '\n0é雨") for _ in range(dice.randrange(60))) for _ in range(300)]
    out = []
    for start in range(0, 300, 7):
        ids, starts = encoder.encode(texts[start : start + 7])
        out += [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
        if start % 21 == 0:
            encoder._forget()
    assert out == expected(library, texts)


def test_array_and_loop_merges_agree(vocabulary, monkeypatch):
    words = [bytes(random.Random(k).choices(range(256), k=k % 40)) for k in range(400)] + [b"the" * 300, b"", b"aaaa"]
    from tessel.llm import bpe

    outs = []
    for least in (2, 10**9):
        monkeypatch.setattr(bpe, "ARRAY_MERGE_FROM", least)
        ids, starts = PairIndexEncoder(vocabulary).encode(words)
        outs.append((ids.tolist(), starts.tolist()))
    assert outs[0] == outs[1]


def test_an_empty_vocabulary_gives_bytes():
    import numpy as np

    none = np.zeros(0, np.int32)
    ids, starts = PairIndexEncoder(BpeVocabulary(np.arange(256, dtype=np.int32), none, none, none)).encode([b"ab", b""])
    assert ids.tolist() == [97, 98] and starts.tolist() == [0, 2, 2]


def test_merges_out_of_order_are_refused():
    import numpy as np

    ids = lambda *x: np.array(x, np.int32)
    assert BpeVocabulary(np.arange(256, dtype=np.int32), ids(1, 256), ids(2, 3), ids(256, 257)).checked()
    for left, right, made in ((ids(256, 1), ids(3, 2), ids(257, 256)), (ids(1, 1), ids(2, 2), ids(256, 257)), (ids(1, 2), ids(2, 3), ids(256, 256))):
        with pytest.raises(ValueError, match="merge"):
            BpeVocabulary(np.arange(256, dtype=np.int32), left, right, made).checked()

"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

A task splits its texts into words, keeps one entry for each different word, encodes the new ones together by the
pair occurrence index of :mod:`.bpe`, and writes every document by gathering its words' ids.  There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORD_PATTERN, BpeVocabulary, PairIndexEncoder

#: Characters a task reads before it encodes its new words.
CHUNK_CHARS = 4_000_000
#: Different words a task remembers before it starts anew.
MOST_WORDS = 600_000


class _Numbers(dict):
    """Numbers keys in the order of their first occurrence."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class CorpusEncoder:
    """Encodes many texts; remembers the words it has seen."""

    def __init__(self, vocabulary: BpeVocabulary):
        self.words_of = regex.compile(WORD_PATTERN).findall
        self.encoder = PairIndexEncoder(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word of all texts, and how many words each text has."""
        split = [self.words_of(t) if t else () for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        done = len(self.starts) - 1
        if len(self.numbers) > done:
            new = [w.encode("utf-8", "surrogatepass") for w in list(self.numbers)[done:]]
            ids, starts = self.encoder.encode(new)
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        return words, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (one entry more than texts)."""
        words, counts = self._words(texts)
        begin = self.starts[words]
        size = self.starts[words + 1] - begin
        upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        at = np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])
        edges = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[at]
        self._limit()
        return ids, upto[edges]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        words, counts = self._words(texts)
        upto = np.concatenate([[0], np.cumsum(np.diff(self.starts)[words])])
        edges = np.concatenate([[0], np.cumsum(counts)])
        self._limit()
        return np.diff(upto[edges])

    def _limit(self) -> None:
        if len(self.numbers) > MOST_WORDS:
            self._forget()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they have ``CHUNK_CHARS`` bytes of text (the last column)."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= CHUNK_CHARS:
            yield pa.Table.from_batches(kept)
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _texts(t: pa.Table) -> list[str | None]:
    return t.column(t.num_columns - 1).to_pylist()


def encode_texts(df: DataFrame, vocabulary: BpeVocabulary, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column`` and ``ids`` of each row: the ids of the text, without special tokens.

    An empty and a null text have an empty list.  Rows stay as they are: repeats, null ids and blank texts are
    encoded like any other.  Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(BpeVocabulary(*shared.value))
        for t in _chunks(batches):
            ids, starts = encoder.encode(_texts(t))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            out = pa.table([t.column(0).combine_chunks(), lists], names=["_id", "ids"])
            yield from out.to_batches(max_chunksize=5_000)

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_column)


def count_tokens(df: DataFrame, vocabulary: BpeVocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of ids of the text; 0 for an empty or a null text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(BpeVocabulary(*shared.value))
        for t in _chunks(batches):
            n = pa.array(encoder.lengths(_texts(t)).astype(np.int64))
            out = pa.table([*t.columns[:-1], n], names=[*names, "n_tokens"])
            yield from out.to_batches(max_chunksize=50_000)

    names = [f"_{k}" for k in range(len(keep))]
    kinds = [df.schema[c].dataType.simpleString() for c in keep]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).alias("_text"))
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "n_tokens bigint"])
    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))

"""Words of a text as 64-bit numbers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a worker remembers the hash of; the memory is emptied when it is full, which changes no result.
REMEMBERED = 300_000
EDGES = b".,;:!?\"'()[]{}<>*|"


class Remembered(dict):
    """A function of a word, worked out once for each word."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, word):
        self[word] = value = self.function(word)
        return value


class WordHashes:
    """64-bit hash of each lower-cased word; words are runs without ASCII white space."""

    def __init__(self, strip: bool = False):
        self.known = Remembered((lambda w: xxhash.xxh3_64_intdigest(w.strip(EDGES))) if strip else xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id); columns as given, a null doc_id stays.

    The ids grow with the documents, so both sides are shuffled at every size.
    """
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct().hint("merge")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def rows(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of few rows, so that very long texts don't add up."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)

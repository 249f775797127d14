"""Benchmark passages in training texts: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.llm.tokens import WordHashes, rows, shingles, texts, without
from centwise.storage import cut

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score over the score of the whole item copied word for word.
THRESHOLD = 0.5
#: Places where an item may start are taken together by so many words.
STEP = 8
#: Bits of the filter that items' n-grams are sent to the tasks in: 512 KB, however many items there are.
FILTER_BITS = 22


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes(strip=True)
    for batch in rows(batches):
        words = [hashes(t) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array([_grams(w).view(np.int64) for w in words], pa.list_(pa.int64()))], ["item_id", "words", "grams"])


def _grams(words: np.ndarray) -> np.ndarray:
    return shingles(words, SEED_WORDS) if len(words) >= SEED_WORDS else words[:0]


def _found(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = grams & np.uint64(2**FILTER_BITS - 1)
    return np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def _windows(bitmap: bytes, reach: int):
    """Stretches of a document's words within ``reach`` of a possible seed, with the places of the seeds."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.frombuffer(bitmap, np.uint8), WordHashes(strip=True)
        for batch in rows(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                if doc_id is None:
                    continue
                words = hashes(text)
                grams = _grams(words)
                at = _found(grams, bits)
                for group in np.split(at, np.flatnonzero(np.diff(at) > 2 * reach) + 1) if len(at) else []:
                    first = max(0, int(group[0]) - reach)
                    out.append((doc_id, first, words[first : int(group[-1]) + reach].view(np.int64), group, grams[group].view(np.int64)))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "first", "words", "at", "grams"])

    return cut_out


def align(item: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` in each row of ``windows`` (padded to one length), and the word it ends at.

    One row of the matrix for all windows at a time; a gap along the row is a running maximum.
    """
    n, width = windows.shape
    inside = np.arange(width)[None, :] < sizes[:, None]
    row = np.zeros((n, width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32) * GAP
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        step = np.where((windows == word) & inside, MATCH, MISMATCH)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        new = np.maximum.accumulate(new - ramp, axis=1) + ramp
        new[:, 1:][~inside] = 0
        row = new
        top = row.argmax(axis=1)
        score = row[np.arange(n), top]
        end = np.where(score > best, top - 1, end)
        best = np.maximum(best, score)
    return best, end


def _aligned(threshold: float):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            out = []
            for doc_id, first, stretch, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "words", "found")), strict=True):
                words = np.array(stretch, np.int64).view(np.uint64)
                for place in found:
                    item = np.array(place["words"], np.int64).view(np.uint64)
                    # edits move the passage by at most the item's length either way
                    low = np.maximum(0, np.unique(np.array(place["starts"])) - first - len(item))
                    windows = [(a, words[a : a + 3 * len(item) + STEP]) for a in low.tolist()]
                    # no alignment scores more than the item's words that are there at all
                    windows = [(a, w) for a, w in windows if np.count_nonzero(np.isin(item, w)) / len(item) >= threshold]
                    for k in range(0, len(windows), 256):
                        starts, part = zip(*windows[k : k + 256], strict=True)
                        sizes = np.array(list(map(len, part)))
                        block = np.zeros((len(part), max(1, int(sizes.max()))), np.uint64)
                        for i, w in enumerate(part):
                            block[i, : len(w)] = w
                        score, end = align(item, block, sizes)
                        top = int(score.argmax())
                        out.append((doc_id, place["item_id"], float(score[top]) / (MATCH * len(item)), first + int(starts[top] + end[top])))
            names, kinds = ["doc_id", "item_id", "score", "last_word"], [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return aligned


def _bitmap(grams: DataFrame) -> bytes:
    """The slots of all ``gram``s; at most 2^22 / 32 rows come to the driver."""
    slot = F.col("gram").bitwiseAND(2**FILTER_BITS - 1)
    words = grams.select(F.shiftright(slot, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(31).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = np.zeros(2 ** (FILTER_BITS - 5), "<u4")
    for word, bits in words:
        bitmap[word] = bits
    return bitmap.tobytes()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, last_word) for every document of ``docs`` (doc_id, text) that holds an item of ``benchmark`` (item_id, text).

    Words are compared without case and outer punctuation.  Every word trigram of
    an item is a seed, so no copy of it, exact or edited, takes seeds from another.
    A document that shares a seed is aligned around it, and only the words around
    seeds are shuffled; ``score`` is the alignment's score over that of the item
    copied whole, and ``last_word`` is where the best alignment ends.  An edited
    copy that keeps no three words in a row shares no seed.

    Items of fewer than three words and null texts match nothing; null ids are
    not reported; rows with equal doc_id are one document, with equal item_id one
    item with several texts, the best score counts; no rows on a side give no rows.
    """
    items = cut(benchmark.select("item_id", "text").where("item_id IS NOT NULL").mapInArrow(_seeds, "item_id bigint, words array<bigint>, grams array<bigint>").where("size(grams) > 0").withColumn("text_no", F.xxhash64("words")), "items")
    seeds = items.select("item_id", "text_no", F.posexplode("grams").alias("place", "gram"))
    given = docs.select("doc_id", "text")
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    windows = cut(given.mapInArrow(_windows(_bitmap(seeds), 3 * (longest + STEP)), "doc_id bigint, first bigint, words array<bigint>, at array<bigint>, grams array<bigint>"), "windows")
    hits = windows.select("doc_id", "first", F.explode(F.arrays_zip("at", "grams")).alias("hit")).select("doc_id", "first", "hit.at", F.col("hit.grams").alias("gram"))
    starts = hits.join(seeds, "gram").groupBy("doc_id", "first", "item_id", "text_no").agg(F.collect_set(F.floor((F.col("at") - F.col("place")) / STEP) * STEP).alias("starts"))
    found = starts.join(items.select("item_id", "text_no", "words"), ["item_id", "text_no"]).groupBy("doc_id", "first").agg(F.collect_list(F.struct("item_id", "words", "starts")).alias("found"))
    aligned = found.join(windows.select("doc_id", "first", "words"), ["doc_id", "first"]).select("doc_id", "first", "words", "found").mapInArrow(_aligned(threshold), "doc_id bigint, item_id bigint, score double, last_word bigint")
    best = aligned.where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("last_word")).alias("last"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.last")).alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item of ``benchmark``; columns as given."""
    return without(docs, contaminated(docs, benchmark, threshold))

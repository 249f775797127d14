"""Phrases whose words keep company more than chance: counts from sorted n-gram streams, joined by merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centwise.llm.tokens import rows
from centwise.storage import cut

LEAST, COVERED, BEST = 10, 50, 2000
#: Words, and different words, that a worker counts in memory before it emits a sorted run; changes no result.
RUN_WORDS, RUN_KINDS = 2_500_000, 250_000
#: Bytes of a text that are split into words at a time; changes no result.
SLICE = 4_000_000
#: Parts into which a language's phrases are dealt before the best of each are compared.
PARTS = 128
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")  # 0xFF is in no UTF-8 text
_END = b"\xff"
_EMIT = 50_000


class Numbered(dict):
    """Words numbered from 1 as they come; 0 stands for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class PrefixRuns:
    """Windows of three words, counted and put in prefix order, one run for each language and some millions of words.

    A window stands for its first word, its first two and all three, so one
    stream carries the counts of every order.  Rows are (head, tail, n): head is
    the language, a tab and one or two words; tail is the third word after a head
    of two, null where the piece ends.  Unigrams have a head of one word, and the
    number of all words a head of none.
    """

    def __init__(self):
        self.numbers = Numbered({_END: 0})
        self.words: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        while text:
            end = len(text)
            if end > SLICE:  # not inside a word
                space = max(text.rfind(b" ", 0, SLICE), text.rfind(b"\n", 0, SLICE))
                end = space + 1 if space >= 0 else min(x for x in (text.find(b" ", SLICE), text.find(b"\n", SLICE), len(text) - 1) if x >= 0) + 1
            found = text[:end].lower().translate(_ENDS).replace(_END, b" \xff ").split(b" ")
            text = text[end:]
            self._put(lang, [w for w in found if w])
            if self.held >= RUN_WORDS or len(self.numbers) >= RUN_KINDS:
                yield from self.flush(lang)
        self._put(lang, [_END])

    def _put(self, lang: str, words: list[bytes]) -> None:
        self.words.setdefault(lang, []).append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.held += len(words)

    def flush(self, within: str | None = None) -> Iterator[pa.RecordBatch]:
        """Everything held as sorted runs; the last two words of ``within``'s open text come with the next run."""
        known = sorted(self.numbers)[:-1]  # 0xFF comes last
        rank = np.zeros(len(self.numbers), np.int64)
        rank[np.fromiter(map(self.numbers.__getitem__, known), np.int64, len(known))] = np.arange(1, len(known) + 1)
        streams, self.words, self.held, self.numbers = self.words, {}, 0, Numbered({_END: 0})
        for lang, parts in streams.items():
            ids = rank[np.concatenate(parts)]
            if lang == within:
                self._put(lang, [known[i - 1] if i else _END for i in ids[-2:]])
            else:
                ids = np.append(ids, [0, 0])
            yield from self._run(lang, ids, known)

    def _run(self, lang: str, ids: np.ndarray, vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        if not (first > 0).any():
            return
        names = pa.array(vocabulary, pa.binary()).cast(pa.string())
        take = lambda at: names.take(pa.array(at - 1))
        lead = f"{lang}\t"
        single, n_single = np.unique(first[first > 0], return_counts=True)
        yield from _batches(pa.array([lead]), pa.nulls(1, pa.string()), np.array([n_single.sum()]))
        yield from _batches(pc.binary_join_element_wise(lead, take(single), ""), pa.nulls(len(single), pa.string()), n_single)
        two = (first > 0) & (second > 0)
        bits = len(vocabulary).bit_length()
        assert 3 * bits < 64
        keys, n = np.unique((first[two] << 2 * bits) | (second[two] << bits) | third[two], return_counts=True)
        low = (1 << bits) - 1
        for at in range(0, len(keys), _EMIT):
            part = keys[at : at + _EMIT]
            head = pc.binary_join_element_wise(pc.binary_join_element_wise(lead, take(part >> 2 * bits), ""), take((part >> bits) & low), " ")
            tail = (part & low) - 1
            yield from _batches(head, names.take(pa.array(tail, mask=tail < 0)), n[at : at + _EMIT])


def _batches(head: pa.Array, tail: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([head, tail, pa.array(n, pa.int64())], ["head", "tail", "n"])
    for at in range(0, batch.num_rows, _EMIT):
        yield batch.slice(at, _EMIT)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = PrefixRuns()
    for batch in rows(batches, 256):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if text.is_valid:
                yield from runs.add(lang, text.as_buffer().to_pybytes())
    yield from runs.flush()


def _summed(least: int):
    """Lockstep sums over a stream sorted by (head, tail): one of the head, one of head and tail; those below ``least`` go."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_head = open_tail = None
        of_head = of_tail = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            head, tail, n = batch.column("head"), batch.column("tail").cast(pa.string()), batch.column("n").to_numpy()
            new_head = np.ones(len(n), bool)
            new_head[1:] = pc.not_equal(head[1:], head[:-1]).to_numpy(zero_copy_only=False)
            ended = pc.fill_null(tail, "\t")  # no word holds a tab
            new_tail = new_head.copy()
            new_tail[1:] |= pc.not_equal(ended[1:], ended[:-1]).to_numpy(zero_copy_only=False)
            heads, tails = np.flatnonzero(new_head), np.flatnonzero(new_tail)
            head_sum, tail_sum = np.add.reduceat(n, heads), np.add.reduceat(n, tails)
            out: list[tuple] = []
            same = head[0].as_py() == open_head
            if same:
                head_sum[0] += of_head
            elif open_head is not None:
                out.append((open_head, None, of_head))
            if same and ended[0].as_py() == open_tail:
                tail_sum[0] += of_tail
            elif open_tail not in (None, "\t"):
                out.append((open_head, open_tail, of_tail))
            open_head, open_tail = head[-1].as_py(), ended[-1].as_py()
            of_head, of_tail = int(head_sum[-1]), int(tail_sum[-1])
            heads, head_sum, tails, tail_sum = heads[:-1], head_sum[:-1], tails[:-1], tail_sum[:-1]
            keep = head_sum >= least
            yield _rows(head.take(pa.array(heads[keep])), pa.nulls(int(keep.sum()), pa.string()), head_sum[keep])
            keep = (tail_sum >= least) & pc.is_valid(tail.take(pa.array(tails))).to_numpy(zero_copy_only=False)
            yield _rows(head.take(pa.array(tails[keep])), tail.take(pa.array(tails[keep])), tail_sum[keep])
            yield _listed(out, least)
        if open_head is not None:
            yield _listed([(open_head, None, of_head)] + ([(open_head, open_tail, of_tail)] if open_tail != "\t" else []), least)

    return total


def _rows(head, tail, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([head.cast(pa.string()), tail, pa.array(n, pa.int64())], ["head", "tail", "n"])


def _listed(found: list[tuple], least: int) -> pa.RecordBatch:
    found = [x for x in found if x[2] >= least]
    return _rows(pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), [x[2] for x in found])


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, n): how often each run of one to three words occurs, ``least`` times at least; ``words`` empty: all words.

    Workers emit runs in prefix order; these are dealt by their first two words,
    merged by Spark's external sort and summed as they stream by.  What follows
    a frequent pair is one row for each run and distinct window, not for each
    occurrence, and no group is held in memory.
    """
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang")
    runs = docs.select(lang, docs["text"].alias("text")).mapInArrow(_count, "head string, tail string, n bigint")
    # a named number: the default would let the planner join small partitions, here one is a stream of any length
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = runs.repartition(parts, "head").sortWithinPartitions("head", "tail").mapInArrow(_summed(least), "head string, tail string, n bigint")
    at = F.length("head") - F.length(F.substring_index("head", "\t", -1))  # a language may hold tabs, words don't
    words = F.when(F.substring_index("head", "\t", -1) == "", F.array().cast("array<string>")).otherwise(F.split(F.substring_index("head", "\t", -1), " "))
    return counted.select(F.col("head").substr(F.lit(1), at - 1).alias("lang"), F.when(F.col("tail").isNull(), words).otherwise(F.concat(words, F.array("tail"))).alias("words"), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)); a is at most l and r, so it fits a long, and the products fit 38 digits up to counts of 10^16."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = (wide(a) * wide(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def scored_phrases(docs: DataFrame, least: int = LEAST, covered: int = COVERED) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a, l, r, score of every phrase that stays, see ``collocations``; lang, n of every language."""
    counts = cut(phrase_counts(docs, least), "phrase-counts")
    size = F.size("words")
    of = lambda k: counts.where(size == k)
    word = lambda c: F.get("words", F.lit(c))
    joined = lambda *c: F.array_join(F.array(*map(word, c)), " ")
    one = lambda name: of(1).select(F.col("lang").alias(f"{name}_lang"), word(0).alias(f"{name}_word"), F.col("n").alias(name)).hint("merge")
    two = lambda name: of(2).select(F.col("lang").alias(f"{name}_lang"), joined(0, 1).alias(f"{name}_word"), F.col("n").alias(name)).hint("merge")

    def count_of(phrases: DataFrame, part: DataFrame, name: str, key: str) -> DataFrame:
        return phrases.join(part, (F.col("lang") == F.col(f"{name}_lang")) & (F.col(key) == F.col(f"{name}_word"))).drop(f"{name}_lang", f"{name}_word")

    # three words: both cuts' counts, in prefix order the first word and the first two, in suffix order the last word and the last two
    triples = of(3).select("lang", joined(0, 1, 2).alias("phrase"), F.col("n").alias("a"), word(0).alias("first"), word(2).alias("last"), joined(0, 1).alias("front"), joined(1, 2).alias("back"))
    for part, name, key in ((one, "first_n", "first"), (two, "back_n", "back"), (two, "front_n", "front"), (one, "last_n", "last")):
        triples = count_of(triples, part(name), name, key)
    score1, score2 = _score(F.col("a"), F.col("first_n"), F.col("back_n")), _score(F.col("a"), F.col("front_n"), F.col("last_n"))
    chosen = F.when(score1 <= score2, F.struct(F.col("first_n").alias("l"), F.col("back_n").alias("r"), score1.alias("score"))).otherwise(F.struct(F.col("front_n").alias("l"), F.col("last_n").alias("r"), score2.alias("score")))
    longest = triples.select("lang", "phrase", "a", chosen.alias("c")).select("lang", "phrase", "a", "c.*")
    # two words: extension counts, the most frequent phrase of three on either side
    pairs = of(2).select("lang", joined(0, 1).alias("phrase"), F.col("n").alias("a"), word(0).alias("first"), word(1).alias("last"))
    for name, key in (("l", "first"), ("r", "last")):
        pairs = count_of(pairs, one(name), name, key)
    sides = of(3).select("lang", F.explode(F.array(joined(0, 1), joined(1, 2))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    open_pairs = pairs.join(sides.hint("merge"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    found = longest.unionByName(open_pairs.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    return found, of(0).select("lang", "n")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of two or three words in ``docs`` (text, lang).

    A-Z are lower-cased; texts are split into pieces at ``.,;:!?``, line ends and
    form feeds, pieces into words at spaces and tabs.  a, l and r count the
    phrase, its first part and the rest over all documents, overlaps included;
    of a phrase of three the cut with the lower score counts, of equal ones the
    first.  A phrase that occurs fewer than ``least`` times is no candidate; one
    inside a phrase of three that occurs ``covered`` percent as often goes.
    Phrases are ranked by score, then a, then phrase in byte order.

    Null and empty texts have no words; a null lang is ``und``; repeated rows
    count each; doc_id and other columns are not looked at; no rows give no rows.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    phrases, totals = scored_phrases(docs, least, covered)
    found = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # no language is ranked in one task: first the best of each part
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Tokens of two tokenizers on one text, linked where they share bytes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.storage import cut

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned at once; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
#: Long texts are walked from several places at once, about this many A tokens apart; changes no result.
LANE = 1024
#: A pair is frequent from one in this many links on, so there are no more frequent pairs than this.
FREQUENT = 65_536
#: Characters on whose classes the two pre-tokenizers agree; texts with others go to the tokenizer file's own library.
_SETTLED = re.compile("[\x00-ɏ‐-‧]*")
#: How the byte-level vocabulary cuts text before merging; fixed pattern of that tokenizer.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 stands for itself, other bytes for what follows U+00FF."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokenizer:
    """The byte-level vocabulary: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = _byte_of()
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in model["vocab"].items():
            if all(c in byte for c in token):
                self.bytes[i] = bytes(byte[c] for c in token)
        self.file = Tokenizer.from_file(path)
        self.file.encode_special_tokens = True
        self.own = None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)):  # ids are ranks of merges
            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.own = tiktoken.Encoding("byte-bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode_ordinary(t) if self.own and _SETTLED.fullmatch(t) else self.file.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokenizer:
    """The sentencepiece vocabulary, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode())

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Callable[[list[str]], list[list[int]]]:
    """One for each worker and file."""
    return PieceTokenizer(path) if path.endswith(".model") else ByteTokenizer(path)


def merge(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of many documents, all walked in lockstep.

    ``ends`` are the byte ends of all documents' tokens, one after another, each
    document's bytes counted on from the one before; ``starts`` are the places
    where each document's tokens begin, and the number of all.  One state vector
    holds the pointers of all lanes.  A step links the tokens pointed to, moves
    on whichever ends first, both where they end together (a cut), and drops the
    lanes that are through.

    Returns linked A places, linked B places, A places and B places that end at a cut.
    """
    a, b = _lanes(ends_a, ends_b, starts_a, starts_b)
    last = np.append(a[1:], starts_a[-1])
    some = a < last  # documents without tokens have no lane
    a, b, last = a[some], b[some], last[some]
    linked_a, linked_b, cut_a, cut_b = [], [], [], []
    while len(a):
        linked_a.append(a)
        linked_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        together = end_a == end_b
        cut_a.append(a[together])
        cut_b.append(b[together])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        if (through := a == last).any():
            on = ~through
            a, b, last = a[on], b[on], last[on]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (linked_a, linked_b, cut_a, cut_b))


def _lanes(ends_a, ends_b, starts_a, starts_b) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin: at each document, and behind every ``LANE``-th A token that ends where a B token ends."""
    probes = np.arange(LANE - 1, len(ends_a), LANE)
    meet = np.searchsorted(ends_b, ends_a[probes])
    good = (meet < len(ends_b)) & (probes + 1 < len(ends_a))
    probes, meet = probes[good], meet[good]
    good = ends_b[meet] == ends_a[probes]
    a = np.concatenate([starts_a[:-1], probes[good] + 1])
    b = np.concatenate([starts_b[:-1], meet[good] + 1])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    # documents without tokens begin where the next one does; the last of equal places is the one that goes on
    last = np.append(first[1:], True)
    return a[last], b[last]


class Aligner:
    """Aligns the texts of a batch; for each its token counts, groups, links, the groups' digest and its id pairs with counts."""

    def __init__(self, a: str, b: str):
        self.a, self.b = tokenizer(a), tokenizer(b)
        self.length_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.length_b = np.array([len(x) for x in self.b.bytes], np.int64)
        size = max(len(self.length_a), len(self.length_b))
        # an id and what follows it: a comma, a bar behind a group's last A token, a semicolon behind its last B token
        self.names = np.array([f"{i}{sign}" for sign in ",|;" for i in range(size)], object)
        self.size = size

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        given = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in given]
        found_a, found_b = self.a(spaced), self.b([texts[i] for i in given])
        good = []
        for k, text in enumerate(spaced):
            raw = text.encode()
            if b"".join(map(self.a.bytes.__getitem__, found_a[k])) == raw and b"".join(map(self.b.bytes.__getitem__, found_b[k])) == raw:
                good.append(k)
        none = (0, 0, 0, 0, "", [], [])
        out: list[tuple] = [none] * len(texts)
        if good:
            for k, row in zip(good, self._align([found_a[k] for k in good], [found_b[k] for k in good])):
                out[given[k]] = row
        return out

    def _align(self, lists_a: list[list[int]], lists_b: list[list[int]]) -> Iterator[tuple]:
        starts_a = np.cumsum([0, *map(len, lists_a)])
        starts_b = np.cumsum([0, *map(len, lists_b)])
        ids_a = np.fromiter((i for x in lists_a for i in x), np.int64, starts_a[-1])
        ids_b = np.fromiter((i for x in lists_b for i in x), np.int64, starts_b[-1])
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        linked_a, linked_b, cut_a, cut_b = merge(ends_a, ends_b, starts_a, starts_b)
        # group numbers: cuts before a token
        is_cut_a, is_cut_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        is_cut_a[cut_a] = 1
        is_cut_b[cut_b] = 1
        group_a, group_b = np.cumsum(is_cut_a) - is_cut_a, np.cumsum(is_cut_b) - is_cut_b
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
        parts = np.empty(len(ids_a) + len(ids_b), object)
        parts[np.arange(len(ids_a)) + before_b[group_a]] = self.names[ids_a + is_cut_a * self.size]
        parts[np.arange(len(ids_b)) + before_a[group_b]] = self.names[ids_b + is_cut_b * 2 * self.size]
        parts = parts.tolist()
        document = np.searchsorted(starts_a, linked_a, "right") - 1
        width = len(self.length_a) * len(self.length_b)
        pairs, times = np.unique(document * width + ids_a[linked_a] * len(self.length_b) + ids_b[linked_b], return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(len(lists_a) + 1) * width)
        n_links = np.bincount(document, minlength=len(lists_a))
        groups = np.diff(np.append(0, np.cumsum(is_cut_a))[starts_a])
        pairs %= width
        for k in range(len(lists_a)):
            text = "".join(parts[starts_a[k] + starts_b[k] : starts_a[k + 1] + starts_b[k + 1]])[:-1]
            part = slice(bounds[k], bounds[k + 1])
            yield len(lists_a[k]), len(lists_b[k]), int(groups[k]), int(n_links[k]), hashlib.sha256(text.encode()).hexdigest(), pairs[part], times[part]


def groups(text: str, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> str:
    """The groups of one text as written into the digest; empty without tokens."""
    first, second = tokenizer(a), tokenizer(b)
    raw, ids_a, ids_b = f" {text}".encode(), first([" " + text])[0], second([text])[0]
    if not text or b"".join(first.bytes[i] for i in ids_a) != raw or b"".join(second.bytes[i] for i in ids_b) != raw:
        return ""
    ends_a, ends_b = np.cumsum([len(first.bytes[i]) for i in ids_a]), np.cumsum([len(second.bytes[i]) for i in ids_b])
    *_, cut_a, cut_b = merge(ends_a, ends_b, np.array([0, len(ids_a)]), np.array([0, len(ids_b)]))
    out, at_a, at_b = [], 0, 0
    for to_a, to_b in zip(np.sort(cut_a) + 1, np.sort(cut_b) + 1):
        out.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
        at_a, at_b = to_a, to_b
    return ";".join(out)


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows taken together up to BATCH_BYTES of text; a longer text comes alone."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        size = np.cumsum(np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def aligned(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs with how many links hold each.

    A pair is A's id times the size of B's vocabulary plus B's id.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch in _batches(batches):
            found = list(zip(*aligner(batch.column("text").to_pylist())))
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.asarray(y, np.int64) for y in x]), pa.int64())) for x in found[5:]]
            plain = [pa.array(x, kind) for x, kind in zip(found[:5], [pa.int64()] * 4 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *plain, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select("doc_id", "text").mapInArrow(align, _ALIGNED)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each id pair over all rows of ``aligned``, and whether its B id has no pair with more."""
    pair = F.explode(F.arrays_zip("pairs", "times")).alias("p")
    counts = rows.select(pair).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    second = (F.col("pair") % size_b).alias("b")
    counts = cut(counts, "pair-counts")
    # one row for each id of B's vocabulary
    most = counts.groupBy(second).agg(F.max("count").alias("most"))
    return counts.withColumn("b", second).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text).

    Tokenizer ``a`` (a byte-level file) reads a space and the text, ``b`` (a
    sentencepiece file) the text.  Byte offsets where tokens of both end cut them
    into groups; tokens whose bytes overlap are linked.  A pair's count is the
    number of links of its two ids over all rows.  ``n_best`` counts the row's
    links whose pair has the highest count of its B id, equals included,
    ``count_sum`` adds up the pair counts of its links.

    Null and empty texts, and texts of which either tokenizer gives other bytes
    back, have no tokens: zeros and an empty digest.  A null doc_id is passed
    through; repeated rows are aligned and counted each; other columns are not
    looked at; no rows give no rows.  A text must fit a worker's memory some
    hundred times.
    """
    size_b = len(tokenizer(b).bytes)
    rows = cut(aligned(docs, a, b).withColumn("key", F.monotonically_increasing_id()), "aligned")
    counts = cut(pair_counts(rows.select("pairs", "times"), size_b), "pair-counts")
    total = rows.agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    is_frequent = F.col("count") * F.lit(FREQUENT).cast("decimal(20,0)") >= F.lit(total)
    one = F.explode(F.arrays_zip("pairs", "times")).alias("p")
    links = rows.select("key", one).select("key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    frequent = counts.where(is_frequent).select("pair", "count", "best")  # at most FREQUENT rows: their counts add up to ``total`` or less
    known = links.join(F.broadcast(frequent), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    # the others hold less than one in FREQUENT of all links each, so no key of this join is hot
    rare = known.where("count IS NULL").select("key", "pair", "times").join(counts.where(~is_frequent).hint("merge"), "pair")
    parts = known.where("count IS NOT NULL").groupBy("key").agg(*sums).unionByName(rare.groupBy("key").agg(*sums))
    own = parts.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = rows.drop("pairs", "times").join(own.hint("merge"), "key", "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")

"""Near-duplicate documents: MinHash banding, signature check, exact check, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.llm.components import connected_components
from centwise.llm.tokens import WordHashes, rows, shingles, texts, without
from centwise.storage import cut

#: Minima of a band, and how often at most a pair at the threshold may share no band: once in fifty million (24 bands at 0.85).
ROWS, MISSED = 4, 2.1e-8
WORDS = 5
#: Sets of a bucket that are compared with each other in one task at a time.
BLOCK = 192


def bands_for(percent: int) -> int:
    share = min(percent, 85) / 100
    return math.ceil(math.log(MISSED) / math.log1p(-(share**ROWS)))


def least_agreement(percent: int) -> float:
    """Share of equal minima below which a pair isn't compared on full sets: seven standard deviations under ``percent``."""
    share = percent / 100
    return share - 7 * math.sqrt(share * (1 - share) / (bands_for(percent) * ROWS))


def universal(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.random.default_rng(20240517)
    return ones.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), ones.integers(0, 2**63, size, dtype=np.uint64)


def minima(shingle_hashes: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of each universal hash (a*x + b mod 2^64, upper half)."""
    a, b = hashes
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(shingle_hashes), 1024):
        part = shingle_hashes[at : at + 1024]
        np.minimum(least, (np.multiply.outer(a, part) + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _set(words: WordHashes, text: bytes | None) -> tuple[np.ndarray, bytes]:
    found = np.unique(shingles(words(text), WORDS))
    return found, xxhash.xxh3_128_digest(found.tobytes())


def _sketch(percent: int):
    hashes = universal(bands_for(percent) * ROWS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in rows(batches):
            n, keys, signatures, bands = [], [], [], []
            for text in texts(batch, "text"):
                found, key = _set(words, text)
                signature = minima(found, hashes)
                n.append(len(found))
                keys.append(key)
                signatures.append(signature.tobytes())
                bands.append(np.array([xxhash.xxh3_64_intdigest(signature[at : at + ROWS].tobytes(), at) for at in range(0, len(signature), ROWS)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return sketch


def _agreeing(percent: int):
    least = least_agreement(percent)

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist(), strict=True)
            keep = [np.count_nonzero(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)) >= least * (len(x) // 4) for x, y in pairs]
            yield batch.select(["a", "key_a", "b", "key_b"]).filter(pa.array(keep, pa.bool_()))

    return agreeing


def _similar(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordHashes(), (None, None)
        for batch in rows(batches, 64):
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("a", "key_a", "b", "key_b")] + [texts(batch, "text_a"), texts(batch, "text_b")]
            for id_a, key_a, id_b, key_b, text_a, text_b in zip(*columns, strict=True):
                if last[0] != text_b:
                    last = (text_b, _set(words, text_b))
                (set_b, found_b), (set_a, found_a) = last[1], _set(words, text_a)
                if (found_a, found_b) != (key_a, key_b):  # another text under the same id
                    continue
                common = len(np.intersect1d(set_a, set_b, assume_unique=True))
                if 100 * common >= percent * (len(set_a) + len(set_b) - common):
                    a.append(id_a)
                    b.append(id_b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return check


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in rows(batches):
        found = [(key, *_set(words, text)) for key, text in zip(batch.column("key_a").to_pylist(), texts(batch, "text"), strict=True)]
        found = [(key, members.tobytes()) for key, members, own in found if key == own]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["key_a", "members"])


def common_members(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of ``a`` with sets of ``b``, some thousands of members at a time."""
    members, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(a), len(b)), np.float32)
    width = 8192
    cuts = np.searchsorted(place, np.arange(0, len(members) + width, width))
    for k in range(len(cuts) - 1):
        table = np.zeros((len(a) + len(b), width), np.float32)
        part = slice(cuts[k], cuts[k + 1])
        table[row[part], place[part] - k * width] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out.astype(np.int64)


def _compared(percent: int):
    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a = block[block["side"] == 0]
        b = a if (block["x"] == block["y"]).all() else block[block["side"] == 1]
        out = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if len(a) and len(b):
            sets_a, sets_b = ([np.frombuffer(m, np.uint64) for m in side["members"]] for side in (a, b))
            common = common_members(sets_a, sets_b)
            both = np.array(list(map(len, sets_a)))[:, None] + np.array(list(map(len, sets_b)))[None, :] - common
            part_a, part_b = a["component"].to_numpy(), b["component"].to_numpy()
            i, j = np.nonzero((100 * common >= percent * both) & (part_a[:, None] != part_b[None, :]))
            # one link joins two components
            out = pd.DataFrame({"a": a["a"].to_numpy()[i], "b": b["a"].to_numpy()[j], "p": part_a[i], "q": part_b[j]}).drop_duplicates(["p", "q"])[["a", "b"]]
        return out

    return compare


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not looked at): doc_id, n_shingles, component_id, kept.

    Sets of hashed 5-word shingles are linked at a Jaccard similarity of
    ``percent``/100 or more, decided on full sets.  Equal sets form one class and
    are compared once.  In each bucket of a band all classes are first compared
    with one of them, the most copied; a bucket whose classes are then still in
    different components is compared whole, in blocks of bounded size, which emit
    one link for two components.  So the rows made follow the input, not the
    square of a group, and every pair that shares a band is linked, connected
    otherwise, or compared.

    Null and empty texts and texts of white space have no shingles and stay
    alone.  Rows with equal doc_id are one document: their texts' components are
    merged and each row is returned.  A null doc_id belongs to no component
    (component_id null) and is kept.  No rows give no rows.
    """
    given = docs.select("doc_id", "text")
    sketch = cut(given.mapInArrow(_sketch(percent), "doc_id bigint, n_shingles bigint, set_key binary, signature binary, bands array<bigint>"), "sketch")
    found = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(found.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes")
    every = classes.select("rep", "set_key", "copies", F.posexplode("bands").alias("band", "hash")).select("rep", "set_key", "copies", F.xxhash64("band", "hash").alias("bucket"))
    pivots = every.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("copies", (-F.col("rep")).alias("rep"), "set_key")).alias("top")).where("n > 1").select("bucket", (-F.col("top.rep")).alias("b"), F.col("top.set_key").alias("key_b"))
    shared = cut(every.join(pivots, "bucket").select("bucket", F.col("rep").alias("a"), F.col("set_key").alias("key_a"), "b", "key_b"), "buckets")
    first = shared.where("key_a <> key_b").select("a", "key_a", "b", "key_b").distinct()
    links = cut(_verified(first, classes, given, percent), "links")
    several = found.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id")
    texts_of = found.join(several, "doc_id").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct()
    same_id = texts_of.join(texts_of.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    # a rep can stand for several sets if its doc_id has several texts; they are one node all the same
    own = shared.select("a", F.col("a").alias("b")).distinct()
    part = cut(connected_components(links.union(own)), "parts")
    members = shared.select("bucket", "a", "key_a", "b", "key_b").join(part.withColumnRenamed("node", "a"), "a")
    split = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low <> high").select("bucket", "blocks")
    open_ = cut(members.join(split, "bucket").select("bucket", "blocks", "a", "key_a", "component"), "open")
    more = cut(_linked_in_blocks(open_, given, percent), "links")
    joined = connected_components(links.union(more).union(same_id)).withColumnRenamed("node", "rep")
    label = cut(classes.select("set_key", "rep").join(joined, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "labels")
    whole = sketch.select("doc_id", "n_shingles", "set_key").join(label, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _linked_in_blocks(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each bucket, from all its pairs, compared block by block on full sets."""
    wanted = members.select("a", "key_a").distinct()
    sets = cut(wanted.join(docs.toDF("a", "text"), "a").mapInArrow(_sets, "key_a binary, members binary").distinct(), "sets")
    own = F.pmod(F.xxhash64("key_a"), F.col("blocks")).cast("int")
    placed = members.withColumn("own", own)
    last = F.col("blocks") - 1
    first = placed.select("bucket", F.col("own").alias("x"), F.explode(F.sequence("own", last)).alias("y"), F.lit(0).alias("side"), "a", "key_a", "component")
    second = placed.where("own > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"), "a", "key_a", "component")
    met = first.union(second).join(sets, "key_a")
    return met.groupBy("bucket", "x", "y").applyInPandas(_compared(percent), "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    signatures = classes.select("set_key", "signature")
    joined = pairs.join(signatures.toDF("key_a", "sig_a"), "key_a").join(signatures.toDF("key_b", "sig_b"), "key_b")
    agreeing = cut(joined.mapInArrow(_agreeing(percent), "a bigint, key_a binary, b bigint, key_b binary"), "agreeing")
    both = agreeing.join(docs.toDF("a", "text_a"), "a").join(docs.toDF("b", "text_b"), "b")
    return both.mapInArrow(_similar(percent), "a bigint, b bigint").distinct()


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` without the documents for which an earlier member of their group stays; columns as given."""
    return without(docs, near_duplicates(docs, percent).where("NOT kept"))

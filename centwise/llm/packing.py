"""Sequences of like length packed into batches: optimal buckets by dynamic programming over the length histogram."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centwise.llm.token_counts import VOCABULARY, token_lengths
from centwise.storage import cut

LONGEST, BUCKETS, BUDGET = 2048, 8, 65_536
#: Sequences numbered in one task.
SHARD_ROWS = 50_000


def boundaries(histogram: dict[int, int], buckets: int) -> tuple[list[int], int]:
    """Upper ends of at most ``buckets`` buckets that minimise total padding, and that padding.

    ``histogram`` maps length to number of sequences.  least[i] is the smallest
    padding of the i shortest lengths; one bucket more is tried for all i at once.
    Ties go to the earlier cut.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return [], 0
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * lengths)])
    far = np.iinfo(np.int64).max // 4
    least = np.full(len(n), far)
    least[0] = 0
    chosen = []
    for _ in range(min(buckets, len(lengths))):
        best, cuts = np.full(len(n), far), np.zeros(len(n), np.int64)
        for i in range(1, len(n)):
            cost = least[:i] + lengths[i - 1] * (n[i] - n[:i]) - (total[i] - total[:i])
            cuts[i] = np.argmin(cost)
            best[i] = cost[cuts[i]]
        if chosen and best[-1] >= least[-1]:
            break
        least = best
        chosen.append(cuts)
    ends, i = [], len(lengths)
    for cuts in reversed(chosen):
        ends.append(int(lengths[i - 1]))
        i = int(cuts[i])
    return ends[::-1], int(least[-1])


def pack(lengths: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Batches for ``lengths`` (doc_id, n_tokens): doc_id, piece, first_token, n_tokens, bucket, batch, place.

    A document longer than ``longest`` tokens is cut into pieces of that length
    and a rest, so no token is dropped and the histogram has ``longest`` entries
    at most.  A sequence is padded to its bucket's length; a batch holds
    ``budget`` // bucket sequences (one at least), only the last batch of a
    bucket fewer.  Order inside a bucket is by a hash of (doc_id, piece).

    Documents of no tokens (null or empty) are in no batch: one row with piece,
    bucket, batch and place null.  A null doc_id is packed like any other;
    repeated rows are packed each; no rows give no rows.
    """
    n, whole = F.coalesce("n_tokens", F.lit(0)), F.lit(longest)
    pieces = cut(
        lengths.select("doc_id", n.cast("bigint").alias("all"))
        .select("doc_id", "all", F.explode_outer(F.when(F.col("all") > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("all") - 1) / whole)))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * whole).alias("first_token"), F.when(F.col("piece").isNotNull(), F.least(whole, F.col("all") - F.col("piece") * whole)).otherwise(0).cast("bigint").alias("n_tokens")),
        "pieces",
    )
    packed = pieces.where("piece IS NOT NULL")
    histogram = {r[0]: r[1] for r in packed.groupBy("n_tokens").count().collect()}  # at most ``longest`` rows
    ends, _ = boundaries(histogram, buckets)
    if not ends:
        return pieces.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("bucket", "batch", "place")))
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= end, end).otherwise(bucket)
    shards = -(-sum(histogram.values()) // SHARD_ROWS)
    order = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece")
    placed = packed.withColumn("bucket", bucket.cast("bigint")).withColumn("order", order).withColumn("shard", F.pmod("order", F.lit(shards)))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "shard").count().select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket", "shard").orderBy("order", "doc_id", "piece")
    numbered = placed.withColumn("row", F.row_number().over(own) - 1).join(offsets, ["bucket", "shard"]).withColumn("row", F.col("row") + F.col("offset"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    out = numbered.select("doc_id", "piece", "first_token", "n_tokens", "bucket", F.floor(F.col("row") / size).alias("batch"), (F.col("row") % size).cast("bigint").alias("place"))
    return out.union(pieces.where("piece IS NULL").select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("bucket", "batch", "place"))))


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``pack`` over the token counts of ``docs`` (doc_id, text)."""
    return pack(token_lengths(docs, vocabulary), longest, buckets, budget)

"""State of a streaming job in folders by key, so that a batch reads what its own keys may touch.

Every row lies in the folder of its key's hash.  A batch writes its rows into a
folder named after its number, one sub-folder for each bucket, and replaces it if
it is run again.  After every ``every`` batches what is current is written down
once more as a snapshot, so a batch reads one snapshot and at most ``every``
batch folders, and of each only the buckets of its keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centwise.storage import delete

#: Buckets of a table; a list of those touched is at most this long.
BUCKETS = 64
#: Batches between two snapshots.
EVERY = 16


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def buckets_of(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    return sorted(r.bucket for r in df.select(bucket(keys, buckets)).distinct().collect())


def store(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A table in folders by key: a few files each, a large bucket written by several tasks."""
    at = bucket(keys, buckets)
    df.withColumn("bucket", at).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str, schema: str, wanted: list[int] | None = None) -> DataFrame:
    """The rows of ``store``, of the wanted buckets only."""
    df = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return df if wanted is None else df.filter(F.col("bucket").isin(wanted))


@dataclass(frozen=True)
class KeyedLog:
    """``schema`` holds the columns that a later batch needs; ``newest`` reduces rows to the current ones."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    newest: Callable[[DataFrame], DataFrame] = lambda rows: rows
    buckets: int = BUCKETS
    every: int = EVERY

    def write(self, df: DataFrame, batch_id: int) -> None:
        """``df`` as batch ``batch_id``; at the end of a stretch a snapshot as well, before the batch counts as done."""
        versioned = df.withColumn("version", F.lit(batch_id).cast("bigint"))
        store(versioned, f"{self.path}/batch_id={batch_id}", self.keys, self.buckets)
        if (batch_id + 1) % self.every == 0:
            current = self.newest(self._rows(self._folders(batch_id) + [f"{self.path}/batch_id={batch_id}"]))
            store(current, self._snapshot(batch_id), self.keys, self.buckets)
            if batch_id >= 2 * self.every:  # the last one is still needed if this batch is run again
                delete(self.spark, self._snapshot(batch_id - 2 * self.every))

    def before(self, batch_id: int, touching: DataFrame) -> DataFrame:
        """Current rows of the batches before ``batch_id`` in the buckets of ``touching``'s keys."""
        wanted = buckets_of(touching, self.keys, self.buckets)
        return self.newest(self._rows(self._folders(batch_id), wanted))

    def batch(self, batch_id: int) -> DataFrame:
        return stored(self.spark, f"{self.path}/batch_id={batch_id}", self.schema)

    def _snapshot(self, batch_id: int) -> str:
        return f"{self.path}-snapshots/upto={batch_id}"

    def _folders(self, batch_id: int) -> list[str]:
        """The last snapshot before ``batch_id`` and the batches since; batches are numbered without gaps."""
        start = batch_id // self.every * self.every
        return ([self._snapshot(start - 1)] if start else []) + [f"{self.path}/batch_id={i}" for i in range(start, batch_id)]

    def _rows(self, folders: list[str], wanted: list[int] | None = None) -> DataFrame:
        schema = f"{self.schema}, version bigint"
        rows = self.spark.createDataFrame([], f"{schema}, bucket int")
        for base, label in ((self.path, "batch_id"), (f"{self.path}-snapshots", "upto")):
            mine = [f for f in folders if f.startswith(f"{base}/")]
            if mine:
                rows = rows.union(self.spark.read.option("basePath", base).schema(f"{schema}, {label} int, bucket int").parquet(*mine).drop(label))
        return (rows if wanted is None else rows.filter(F.col("bucket").isin(wanted))).drop("bucket")

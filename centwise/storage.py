"""Where intermediate tables go, and how a plan's lineage is cut.

Loops (one-to-one assignment) and composites that read one result many times
write it to Parquet in the shared folder the cluster names in
``spark.checkpoint.dir``.  A table written there outlives any executor, is
pruned and pushed into like every other scan, and carries true sizes for the
planner's broadcast decision.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_fallback: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a private one where none is set and all tasks run in this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master or 'unknown'})")
    global _fallback
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="spark-centwise-")
        atexit.register(shutil.rmtree, _fallback, ignore_errors=True)
    return _fallback


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables that a loop writes in turn: what a round settled stays, what it left open goes when the next round is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.last = spark, name, None

    def put(self, df: DataFrame, settled: str) -> tuple[DataFrame, DataFrame]:
        """(rows where the boolean ``settled`` is true, the others), both without that column."""
        path = new_path(self.spark, self.name)
        df.withColumn("_settled", F.col(settled).cast("int")).drop(settled).write.partitionBy("_settled").parquet(path)
        written = self.spark.read.schema(T.StructType([*df.drop(settled).schema.fields, T.StructField("_settled", T.IntegerType())])).parquet(path)
        if self.last is not None:
            delete(self.spark, f"{self.last}/_settled=0")
        self.last = path
        return written.filter("_settled = 1").drop("_settled"), written.filter("_settled = 0").drop("_settled")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

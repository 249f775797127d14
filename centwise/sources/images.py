"""Index of captured receipt images: content hash, type and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from centwise.config import RECEIPT, ReceiptConfig

# Accepted file endings and their media type.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "pdf": "application/pdf"}


def index_images(spark: SparkSession, path: str, cfg: ReceiptConfig = RECEIPT) -> tuple[DataFrame, DataFrame]:
    """(images, rejects); the SHA-256 of the bytes is the idempotency key."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[ending]
    seen = files.select("path", "length", media.alias("media_type"), F.sha2("content", 256).alias("image_hash"))
    reason = F.when(F.col("media_type").isNull(), "MIME_REJECTED")
    if cfg.max_image_bytes is not None:
        reason = reason.when(F.col("length") > cfg.max_image_bytes, "SIZE_EXCEEDED")
    judged = seen.withColumn("reason", reason)
    rejects = judged.filter("reason IS NOT NULL").select(F.lit("images").alias("source"), F.col("path").alias("row_ref"), "reason", F.col("length").cast("string").alias("raw"))
    return judged.filter("reason IS NULL").drop("reason"), rejects

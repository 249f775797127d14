"""Landed pages of the bank change feed, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from centwise.functions.keys import dedup_key
from centwise.functions.money import half_up
from centwise.functions.text import clean_bank_merchant

_TXN = (
    "struct<transaction_id: string, account_id: string, amount: double, date: string, name: string, merchant_name: string, pending: boolean, "
    "pending_transaction_id: string, category_detailed: string>"
)
PAGE_SCHEMA = (
    f"login_id string, page_no bigint, cursor string, has_more boolean, update_status string, added array<{_TXN}>, modified array<{_TXN}>, "
    "removed array<struct<transaction_id: string, account_id: string>>"
)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def stream_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def page_changes(pages: DataFrame) -> DataFrame:
    """One row per change, ordered by (page_no, phase, pos): added, then modified, then removed.

    The feed counts money out as positive; amounts are turned to the bank sign here.
    """
    def side(name: str, phase: int) -> DataFrame:
        t = pages.select("login_id", "page_no", F.posexplode(name).alias("pos", "t")).withColumn("phase", F.lit(phase))
        merchant = F.coalesce("t.merchant_name", "t.name")
        cents = -half_up(F.col("t.amount") * F.lit(100.0))
        return t.select(
            "login_id", "page_no", "phase", "pos", F.lit(name).alias("op"), F.col("t.account_id").alias("external_account_id"), F.col("t.transaction_id").alias("external_id"),
            F.try_to_date("t.date", "yyyy-MM-dd").alias("posted_date"), cents.alias("amount_cents"), merchant.alias("raw_merchant"),
            clean_bank_merchant(merchant).alias("normalized_merchant"), F.col("t.pending").alias("pending"),
            F.col("t.pending_transaction_id").alias("pending_external_id"), F.col("t.category_detailed").alias("category_hint"),
        )

    gone = pages.select("login_id", "page_no", F.posexplode("removed").alias("pos", "t")).select(
        "login_id", "page_no", F.lit(2).alias("phase"), "pos", F.lit("removed").alias("op"), F.col("t.account_id").alias("external_account_id"),
        F.col("t.transaction_id").alias("external_id"),
    )
    return side("added", 0).unionByName(side("modified", 1)).unionByName(gone, allowMissingColumns=True)


def stored_key(account: Column) -> Column:
    """Idempotency key of a feed line."""
    source_hash = F.sha2(F.concat(F.lit("feed:"), "external_id"), 256)
    return dedup_key(account, F.col("posted_date"), F.col("amount_cents"), F.col("normalized_merchant"), source_hash)

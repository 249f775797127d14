"""Which reader takes which kind of file. Add a reader by registering a callable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from centwise.functions.keys import dedup_key
from centwise.sources.bank_csv import read_bank_csv
from centwise.sources.digital_receipts import read_digital_receipts
from centwise.sources.order_csv import read_order_history

REJECT_SCHEMA = "source string, row_ref string, reason string, raw string"


@dataclass(frozen=True)
class ImportContext:
    household_id: str
    account_id: str | None = None


@dataclass(frozen=True)
class Imported:
    tables: dict[str, DataFrame]
    rejects: DataFrame


Reader = Callable[[SparkSession, str, ImportContext], Imported]


def _reject(spark: SparkSession, source: str, ref: str, reason: str) -> DataFrame:
    return spark.createDataFrame([(source, ref, reason, None)], REJECT_SCHEMA)


def _bank(spark: SparkSession, path: str, ctx: ImportContext) -> Imported:
    rows, rejects = read_bank_csv(spark, path)
    if ctx.account_id is None:
        orphans = rows.select(
            F.lit("bank").alias("source"), F.col("source_row_hash").alias("row_ref"), F.lit("transaction requires an accountId in ImportContext").alias("reason"), F.lit(None).cast("string").alias("raw")
        )
        return Imported({}, rejects.unionByName(orphans))
    account = F.lit(ctx.account_id)
    key = dedup_key(account, F.col("posted_date"), F.col("amount_cents"), F.col("normalized_merchant"), F.col("source_row_hash"))
    return Imported({"transactions": rows.withColumn("household_id", F.lit(ctx.household_id)).withColumn("account_id", account).withColumn("dedup_key", key)}, rejects)


def _orders(spark: SparkSession, path: str, ctx: ImportContext) -> Imported:
    orders, items, rejects = read_order_history(spark, path)
    hh = F.lit(ctx.household_id)
    return Imported({"orders": orders.withColumn("household_id", hh), "order_items": items.withColumn("household_id", hh)}, rejects)


def _receipts(spark: SparkSession, path: str, ctx: ImportContext) -> Imported:
    receipts, items, rejects = read_digital_receipts(spark, path)
    hh = F.lit(ctx.household_id)
    return Imported({"receipts": receipts.withColumn("household_id", hh), "receipt_items": items.withColumn("household_id", hh)}, rejects)


READERS: list[tuple[str, tuple[str, ...], Reader]] = [("bank", (".csv",), _bank), ("orders", (".csv",), _orders), ("receipts", (".json",), _receipts)]


def register_reader(kind: str, endings: tuple[str, ...], reader: Reader) -> None:
    READERS.append((kind, endings, reader))


def import_source(spark: SparkSession, kind: str, path: str, ctx: ImportContext) -> Imported:
    """The first reader that supports kind and file ending; none gives one reject row, no exception."""
    for known, endings, reader in READERS:
        if known == kind and (path.lower().endswith(endings) or "." not in path.rsplit("/", 1)[-1]):
            return reader(spark, path, ctx)
    return Imported({}, _reject(spark, kind, path, f"no adapter supports {kind!r}"))

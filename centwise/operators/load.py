"""Idempotent loads: rows whose key is already stored, or came earlier in the batch, are skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

KEY = "household_id"


def _keyed(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _place(batch: DataFrame) -> Column:
    """Path and row number of a row read from a file that knows them; splits are read in order of their size, so their numbers don't tell."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        batch.select(place).schema
    except AnalysisException:
        return F.monotonically_increasing_id()
    return place


def insert_or_ignore(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` to insert.

    Within the batch the first row by ``order`` wins.  Without one it is the row
    that stands first by file path and place in the file, where the batch is read
    from Parquet files; other batches are taken in the order of their partitions.
    As with a unique index, a row with a missing key part never conflicts.
    """
    columns = batch.columns
    whole = _keyed(keys)
    keyed = batch.filter(whole)
    if not order:
        order, keyed = ["_at"], keyed.withColumn("_at", _place(batch))
    rest = [c for c in columns if c not in keys and c not in order]
    first = keyed.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row")).select(*keys, "_row.*").select(*columns)
    fresh = first.join(existing.select(*keys), keys, "left_anti").select(*columns)
    return fresh.unionByName(batch.filter(~whole))


def load_counts(batch: DataFrame, inserted: DataFrame, rejects: DataFrame, by: list[str]) -> DataFrame:
    """Per source: rows inserted, duplicates skipped, rows rejected."""
    stacked = (
        batch.select(*by, F.lit(1).alias("seen"), F.lit(0).alias("ins"), F.lit(0).alias("bad"))
        .unionByName(inserted.select(*by, F.lit(0).alias("seen"), F.lit(1).alias("ins"), F.lit(0).alias("bad")))
        .unionByName(rejects.select(*by, F.lit(0).alias("seen"), F.lit(0).alias("ins"), F.lit(1).alias("bad")))
    )
    return stacked.groupBy(*by).agg(
        F.sum("ins").alias("inserted"), (F.sum("seen") - F.sum("ins")).alias("skipped_duplicates"), F.sum("bad").alias("errors")
    )


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``reason`` are rejects; nothing is dropped."""
    good = rows.filter(F.col("reason").isNull()).drop("reason")
    return good, rows.filter(F.col("reason").isNotNull())


def union_rejects(*parts: DataFrame) -> DataFrame:
    """One reject table over all sources: source, row_ref, reason, raw."""
    return reduce(DataFrame.unionByName, [p.select("source", "row_ref", "reason", "raw") for p in parts])


def accrue_credit(new_items: DataFrame) -> DataFrame:
    """A positive credit row for every newly inserted return that was not refunded to a card."""
    owed = new_items.filter(F.col("is_return") & F.col("refund_destination").isNotNull() & (F.col("refund_destination") != "card"))
    return owed.select(
        F.concat(F.lit("sc-"), "id").alias("id"), KEY, F.col("refund_destination").alias("kind"), F.abs("amount_cents").alias("amount_cents"),
        F.col("id").alias("order_item_id"),
    )

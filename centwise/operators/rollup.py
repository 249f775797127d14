"""Spend by category and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from centwise.functions.dates import month_of
from centwise.functions.money import bank_to_spend
from centwise.operators.candidates import KEY


def first_items(items: DataFrame) -> DataFrame:
    """Category, rationale and merchant text of each event's first item."""
    top = F.min(F.struct("item_rank", "category", "rationale", "source")).alias("t")
    return items.groupBy(KEY, "event_id").agg(top).select(KEY, "event_id", "t.category", "t.rationale", "t.source")


def event_cells(events: DataFrame, items: DataFrame) -> DataFrame:
    """Each event with the one (category, month) cell it counts in."""
    known = "category_fallback" in events.columns
    fallback = F.col("category_fallback") if known else F.lit(None).cast("string")
    return events.join(first_items(items).select(KEY, "event_id", F.col("category").alias("_first")), [KEY, "event_id"], "left").select(
        KEY, "event_id", "signed_spend_cents", F.coalesce("_first", fallback, F.lit("uncategorized")).alias("category"),
        month_of(F.col("occurred_on")).alias("month"),
    )


def ledger_rollup(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY, "category", "month").agg(F.sum("signed_spend_cents").alias("net_spend_cents"), F.count("*").alias("events"))


def net_spend(events: DataFrame) -> DataFrame:
    return events.groupBy(KEY).agg(F.sum("signed_spend_cents").alias("net_spend_cents"))


def counted_items(receipt_items: DataFrame, matches: DataFrame) -> DataFrame:
    """Receipt items that a matched or manual match row names."""
    named = matches.filter(F.col("status").isin("matched", "manual") & F.col("receipt_item_id").isNotNull())
    return receipt_items.join(named.select(F.col("receipt_item_id").alias("id")), "id", "left_semi")


def live_rollup(receipt_items: DataFrame, receipts: DataFrame, matches: DataFrame, categories: DataFrame, month: str | None = None) -> DataFrame:
    """Counted, categorised receipt items by category and purchase month; purchases are negative here."""
    head = receipts.filter("purchased_at IS NOT NULL").select(KEY, F.col("id").alias("receipt_id"), month_of(F.col("purchased_at")).alias("month"))
    if month is not None:
        head = head.filter(F.col("month") == month)
    named = counted_items(receipt_items.filter("category_id IS NOT NULL"), matches)
    cents = bank_to_spend(F.col("line_price_cents") - F.col("discount_cents"))
    sums = named.join(head, [KEY, "receipt_id"]).groupBy(KEY, "category_id", "month").agg(F.sum(cents).alias("net_cents"))
    return sums.join(categories, "category_id").select(KEY, "category", "month", "net_cents")


def by_month_and_category(rollup: DataFrame) -> DataFrame:
    """Order of presentation; nothing downstream depends on it."""
    return rollup.orderBy(KEY, "month", "category")

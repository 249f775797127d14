"""Matches merged into spend events that count each dollar once.

A bank line anchors before a credit row.  Lines of a split charge anchor
together, and only if all of them are present; a credit row anchors only where
no linked order is already anchored by a bank line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.functions.money import bank_to_spend
from centwise.functions.rules import classified, keyword_category, search_text
from centwise.operators.candidates import KEY
from centwise.operators.refunds import event_record
from centwise.storage import cut


def _links(matches: DataFrame, anchor) -> DataFrame:
    return matches.select(KEY, anchor.alias("anchor"), "receipt_id", "order_id")


def merge_counted(matches: DataFrame, bank: DataFrame, orders: DataFrame, accruals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, links): links name every (event, receipt or order) that an event merged."""
    line = bank.select(KEY, F.col("id").alias("transaction_id"), "amount_cents", "posted_date")
    # single lines
    single = matches.filter(F.col("type").isin("receipt_bank", "order_bank") & F.col("transaction_id").isNotNull())
    one = (
        single.groupBy(KEY, "transaction_id").agg(F.min("receipt_id").alias("receipt_id"), F.min("order_id").alias("order_id"))
        .join(line, [KEY, "transaction_id"])
    )
    events = event_record(
        one, event_id=F.concat(F.lit("led-bank-"), "transaction_id"), signed_spend_cents=bank_to_spend(F.col("amount_cents")),
        occurred_on=F.col("posted_date"), funded_by=F.lit("bank"), transaction_id=F.col("transaction_id"),
        order_id=F.col("order_id"), receipt_id=F.col("receipt_id"),
    )
    links = _links(single, F.concat(F.lit("led-bank-"), "transaction_id"))
    # split charges; the sorted line set is the anchor
    ids = F.array_sort(F.coalesce("transaction_ids", F.array("transaction_id")))
    split = matches.filter((F.col("type") == "order_bank_split") & (F.col("transaction_ids").isNotNull() | F.col("transaction_id").isNotNull())).withColumn("ids", ids)
    groups = split.groupBy(KEY, "ids").agg(F.min("receipt_id").alias("receipt_id"), F.min("order_id").alias("order_id"))
    parts = (
        groups.withColumn("transaction_id", F.explode("ids")).join(line, [KEY, "transaction_id"])
        .groupBy(KEY, "ids", "receipt_id", "order_id")
        .agg(F.count("*").alias("present"), F.sum("amount_cents").alias("amount_cents"), F.min(F.struct("posted_date", "transaction_id")).alias("first"))
        .filter(F.col("present") == F.size("ids"))
    )
    split_id = F.concat(F.lit("led-split-"), F.array_join("ids", "+"))
    events = events.unionByName(event_record(
        parts, event_id=split_id, signed_spend_cents=bank_to_spend(F.col("amount_cents")), occurred_on=F.col("first.posted_date"),
        funded_by=F.lit("bank"), transaction_id=F.col("first.transaction_id"), order_id=F.col("order_id"), receipt_id=F.col("receipt_id"),
    ))
    links = links.unionByName(_links(split, split_id))
    # credit rows
    bank_orders = single.select(KEY, "order_id").unionByName(split.select(KEY, "order_id")).filter("order_id IS NOT NULL").distinct()
    credit = matches.filter((F.col("type") == "store_credit_drawdown") & F.col("credit_id").isNotNull())
    spoiled = credit.join(bank_orders, [KEY, "order_id"], "left_semi").select(KEY, "credit_id").distinct()
    by_credit = (
        credit.groupBy(KEY, "credit_id").agg(F.min("receipt_id").alias("receipt_id"), F.min("order_id").alias("linked_order"))
        .join(spoiled, [KEY, "credit_id"], "left_anti")
        .join(accruals.select(KEY, F.col("id").alias("credit_id"), "amount_cents", "occurred_on", F.col("order_id").alias("own_order")), [KEY, "credit_id"])
        .join(bank_orders.withColumnRenamed("order_id", "own_order"), [KEY, "own_order"], "left_anti")
        .withColumn("order_id", F.coalesce("linked_order", "own_order")).filter("order_id IS NOT NULL")
    )
    events = events.unionByName(event_record(
        by_credit, event_id=F.concat(F.lit("led-sc-"), "credit_id"), signed_spend_cents=F.col("amount_cents"), occurred_on=F.col("occurred_on"),
        funded_by=F.lit("store_credit"), order_id=F.col("order_id"), receipt_id=F.col("receipt_id"),
    ))
    links = links.unionByName(_links(credit, F.concat(F.lit("led-sc-"), "credit_id")))
    return events, links.withColumnRenamed("anchor", "event_id")


def _leading(items: DataFrame, parent: str, *order: str) -> DataFrame:
    """Items with the least ``order`` among those of their receipt or order; several where it repeats."""
    least = F.min(F.struct(*order)).over(W.partitionBy(KEY, parent))
    return items.withColumn("_least", least).filter(F.col("_least").eqNullSafe(F.struct(*order))).drop("_least")


def event_items(
    events: DataFrame, links: DataFrame, receipts: DataFrame, receipt_items: DataFrame, order_items: DataFrame, leading: bool = False
) -> DataFrame:
    """Items of each event, classified: receipt lines first, then order lines that are not returns.

    ``item_rank`` orders the items of an event; the least one decides its category.
    With ``leading`` only the first items of each receipt and order are returned, so
    an event's first item is among them and few others.
    """
    kept = links.join(events.select(KEY, "event_id"), [KEY, "event_id"], "left_semi")
    merchant = receipts.select(KEY, F.col("id").alias("receipt_id"), F.coalesce("store", F.lit("")).alias("merchant"))
    from_receipts = (
        kept.filter("receipt_id IS NOT NULL").select(KEY, "event_id", "receipt_id").distinct()
        .join(receipt_items.select(
            KEY, "receipt_id", F.col("id").alias("receipt_item_id"), F.coalesce("canonical_name", "raw_description").alias("description"), "line_no",
        ).transform(lambda df: _leading(df, "receipt_id", "line_no") if leading else df), [KEY, "receipt_id"])
        .join(merchant, [KEY, "receipt_id"])
        .select(
            KEY, "event_id", F.struct(F.lit(0).alias("side"), F.col("receipt_id").alias("parent"), F.lit("").alias("shipment"), F.col("line_no").alias("seq")).alias("item_rank"),
            "receipt_item_id", F.lit(None).cast("string").alias("order_item_id"), "merchant", "description",
        )
    )
    from_orders = (
        kept.filter("order_id IS NOT NULL").select(KEY, "event_id", "order_id").distinct()
        .join(order_items.filter(~F.col("is_return")).select(
            KEY, "order_id", F.col("id").alias("order_item_id"), "description", "shipment_id", "item_seq",
        ).transform(lambda df: _leading(df, "order_id", "shipment_id", "item_seq") if leading else df), [KEY, "order_id"])
        .select(
            KEY, "event_id", F.struct(F.lit(1).alias("side"), F.col("order_id").alias("parent"), F.col("shipment_id").alias("shipment"), F.col("item_seq").alias("seq")).alias("item_rank"),
            F.lit(None).cast("string").alias("receipt_item_id"), "order_item_id", F.lit("Amazon").alias("merchant"), "description",
        )
    )
    items = from_receipts.unionByName(from_orders)
    # read twice, for the distinct texts and for the items; the first ones are few, so they are stored
    return classify_items(cut(items, "leading-items") if leading else items)


def classify_items(items: DataFrame) -> DataFrame:
    """Apply the keyword rules to the distinct texts only, then join the outcome back."""
    texts = items.withColumn("_text", search_text(F.col("merchant"), F.col("description")))
    hits = texts.select("_text").distinct().withColumn("_hit", keyword_category(F.col("_text")))
    out = texts.join(hits, "_text", "left").withColumn("_c", classified(F.col("merchant"), F.col("_hit")))
    return out.select(*items.columns, "_c.category", "_c.rationale", "_c.source")

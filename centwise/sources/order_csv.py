"""Retailer order-history exports: one row per item and shipment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from centwise.functions.dates import to_date_any
from centwise.functions.keys import hash_of
from centwise.functions.money import amount_to_cents
from centwise.functions.receipt_lines import payment_to_refund_destination
from centwise.functions.text import trim
from centwise.sources.csv_cells import csv_cells
from centwise.storage import cut

# The commerce columns read; no address, gift or tracking column is.
COLUMNS = [
    "ASIN", "Currency", "Order Date", "Order ID", "Order Status", "Original Quantity", "Payment Method Type", "Product Name",
    "Ship Date", "Shipment Item Subtotal", "Shipment Status", "Total Amount", "Unit Price",
]


def read_order_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, order_items, rejects)."""
    # headers are found first, so rows are read twice; the text is cut into cells once
    cells = cut(csv_cells(spark, path), "order-cells")
    names = F.transform("cells", lambda c: trim(F.coalesce(c, F.lit(""))))
    places = F.struct(*[(F.array_position(names, c) - 1).cast("int").alias(c) for c in COLUMNS])
    # every file has its own header, its first row, whatever the order of its columns; written, they have a size that the
    # planner knows, and the rows need not be shuffled to meet them
    tops = cut(cells.groupBy("file").agg(F.min("pos").alias("pos")), "order-tops")
    heads = cut(cells.join(tops, ["file", "pos"]).select("file", F.struct("pos", places.alias("at")).alias("head")), "order-heads")

    def col(name: str) -> Column:
        at = F.col(f"head.at.`{name}`")
        return F.when(at >= 0, trim(F.coalesce(F.get("cells", at), F.lit("")))).otherwise("")

    # a filter computes its expressions anew, so the tests are made to end at the first column that has a text
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`") != "" for c in COLUMNS])
    rows = cells.join(heads, "file").filter(F.col("pos") > F.col("head.pos")).select(
        "file", "pos", F.col("head.pos").alias("start"), *[col(c).alias(c) for c in COLUMNS]
    ).filter(some)
    amount_raw = F.when(F.col("Total Amount") != "", F.col("Total Amount")).otherwise(F.col("Shipment Item Subtotal"))
    quantity = F.regexp_extract("Original Quantity", r"^[-+]?[0-9]+", 0).try_cast("int")
    ship = F.when(F.col("Ship Date") == "", "unshipped").otherwise(F.coalesce(F.date_format(to_date_any(F.col("Ship Date")), "yyyy-MM-dd"), F.col("Ship Date")))
    parsed = rows.select(
        "file", "pos", "start", F.col("Order ID").alias("external_order_id"), amount_raw.alias("amount_raw"), amount_to_cents(amount_raw).alias("amount_cents"),
        F.col("Order Date").alias("order_date_raw"), to_date_any(F.col("Order Date")).alias("order_date"), ship.alias("shipment_id"),
        F.when(quantity > 0, quantity).otherwise(1).alias("quantity"), amount_to_cents(F.col("Unit Price")).alias("unit_price_cents"),
        payment_to_refund_destination(F.col("Payment Method Type")).alias("method"),
        F.when(F.col("Product Name") != "", F.col("Product Name")).otherwise("(unknown item)").alias("description"),
        F.when(F.col("Currency") != "", F.col("Currency")).otherwise("USD").alias("currency"),
        *[F.col(c).alias(a) for c, a in [("ASIN", "asin"), ("Unit Price", "unit_raw"), ("Order Status", "order_status"), ("Shipment Status", "ship_status"), ("Payment Method Type", "payment")]],
    )
    reason = (
        F.when(F.col("external_order_id") == "", "missing Order ID")
        .when(F.col("amount_cents").isNull(), F.concat(F.lit("unparseable amount: "), "amount_raw"))
        .when(F.col("order_date").isNull(), F.concat(F.lit("unparseable Order Date: "), "order_date_raw"))
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL")
    is_return = F.col("amount_cents") < 0
    items = good.select(
        "file", "external_order_id", "shipment_id",
        F.row_number().over(W.partitionBy("file", "external_order_id", "shipment_id").orderBy("pos")).cast("bigint").alias("item_seq"),
        "description", "quantity", "unit_price_cents", "amount_cents", is_return.alias("is_return"), F.when(is_return, F.col("method")).alias("refund_destination"),
        hash_of(*[F.col(c) for c in ["external_order_id", "shipment_id", "asin", "description", "unit_raw", "quantity", "amount_raw", "order_status", "ship_status", "payment"]]).alias("source_row_hash"),
    )
    orders = good.groupBy("file", "external_order_id").agg(
        F.sum("amount_cents").alias("order_total_cents"), F.min(F.struct("pos", "order_date", "currency")).alias("first"), F.count("*").alias("items")
    ).select("file", F.lit("amazon").alias("source"), "external_order_id", "first.order_date", "first.currency", "order_total_cents", "items")
    bad = judged.filter("reason IS NOT NULL")
    rejects = bad.select(
        F.lit("orders").alias("source"), F.concat(F.lit("row:"), (F.col("pos") - F.col("start") + 1).cast("string")).alias("row_ref"), "reason",
        F.concat_ws("|", "external_order_id", "order_date_raw", "amount_raw", "description").alias("raw"),
    )
    return orders, items, rejects

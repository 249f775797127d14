"""Read-side views over stored tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from centwise.functions.dates import month_of
from centwise.functions.money import from_pct, read_status
from centwise.functions.receipt_lines import parse_bbox
from centwise.operators.rollup import counted_items

KEY = "household_id"


def list_matches(matches: DataFrame, transactions: DataFrame) -> DataFrame:
    """Match rows that are not rejected, with the status and confidence shown to people."""
    live = matches.filter(F.col("status") != "rejected")
    own = transactions.select(KEY, F.col("id").alias("transaction_id"))
    return live.join(own, [KEY, "transaction_id"]).select(
        KEY, "id", "transaction_id", "order_item_id", "receipt_item_id", "receipt_id", "order_id",
        read_status(F.col("status")).alias("status"), from_pct(F.col("confidence")).alias("confidence"), "method",
    )


def ambiguous_candidates(matches: DataFrame, transactions: DataFrame) -> DataFrame:
    """Open candidates, one row each; a transaction's rows are its group."""
    return list_matches(matches, transactions).filter(F.col("status") == "ambiguous")


def ambiguous_groups(matches: DataFrame, transactions: DataFrame) -> DataFrame:
    return ambiguous_candidates(matches, transactions).groupBy(KEY, "transaction_id").agg(F.count("*").alias("candidates"))


def unmatched_transactions(transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """Posted lines without a match row of any status."""
    return transactions.filter(~F.col("pending")).join(matches.select(F.col("transaction_id").alias("id")), "id", "left_anti")


def account_summary(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transaction count and latest date of every account, empty ones included."""
    per = transactions.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("n"), F.max("posted_date").alias("latest_posted"))
    return accounts.join(per, "id", "left").select(
        "id", KEY, "name", "type", "login_id", F.coalesce("n", F.lit(0)).alias("transactions"), "latest_posted",
        F.when(F.col("login_id").isNotNull(), "connected").otherwise("other").alias("section"),
    )


def _month(df: DataFrame, date: str, month: str | None) -> DataFrame:
    return df if month is None else df.filter(month_of(F.col(date)) == month)


def valid_month(month: str | None) -> str | None:
    """A month argument that is not ``YYYY-MM`` is ignored."""
    return month if month and re.fullmatch(r"[0-9]{4}-[0-9]{2}", month) else None


def true_spend_items(
    receipt_items: DataFrame, receipts: DataFrame, order_items: DataFrame, orders: DataFrame, transactions: DataFrame,
    matches: DataFrame, categories: DataFrame, month: str | None = None,
) -> DataFrame:
    """What stands behind each category: receipt items, order items and bank lines."""
    month = valid_month(month)
    named = receipt_items.join(categories, "category_id")
    slips = _month(receipts.select(KEY, F.col("id").alias("receipt_id"), "purchased_at"), "purchased_at", month)
    a = counted_items(named, matches).join(slips, [KEY, "receipt_id"]).select(
        KEY, F.lit("receipt_item").alias("kind"), "id", F.coalesce("canonical_name", "raw_description").alias("description"),
        (F.col("line_price_cents") - F.col("discount_cents")).alias("amount_cents"), "category",
    )
    links = (
        matches.filter(F.col("status").isin("matched", "manual") & F.col("receipt_item_id").isNotNull())
        .select("transaction_id", "order_item_id", "receipt_item_id")
        .join(named.select(F.col("id").alias("receipt_item_id"), "category"), "receipt_item_id")
    )
    dated = _month(orders.select(KEY, F.col("id").alias("order_id"), "order_date"), "order_date", month)
    b = (
        order_items.select(KEY, "order_id", F.col("id").alias("order_item_id"), "description", "amount_cents")
        .join(dated, [KEY, "order_id"]).join(links.select("order_item_id", "category"), "order_item_id")
        .select(KEY, F.lit("order_item").alias("kind"), F.col("order_item_id").alias("id"), "description", "amount_cents", "category")
    )
    c = (
        _month(transactions, "posted_date", month).select(KEY, F.col("id").alias("transaction_id"), "normalized_merchant", "amount_cents")
        .join(links.select("transaction_id", "category").distinct(), "transaction_id")
        .select(KEY, F.lit("transaction").alias("kind"), F.col("transaction_id").alias("id"), F.col("normalized_merchant").alias("description"), "amount_cents", "category")
    )
    return a.unionByName(b).unionByName(c)


def true_spend_breakdown(rollup: DataFrame, items: DataFrame) -> DataFrame:
    """Each (category, month) total with every item of the category, one row per item."""
    return rollup.join(items, [KEY, "category"], "left")


def resolve_evidence(ids: DataFrame, receipt_items: DataFrame, order_items: DataFrame, transactions: DataFrame) -> DataFrame:
    """What an id points at: a receipt region, an order row, a bank line, or nothing."""
    box = receipt_items.select(KEY, F.col("id").alias("item_id"), F.col("receipt_id").alias("_receipt"), (parse_bbox(F.col("bbox")) if "bbox" in receipt_items.columns else F.lit(None).cast("struct<x:double,y:double,width:double,height:double>")).alias("bbox"))
    row = order_items.select(KEY, F.col("id").alias("item_id"), F.col("order_id").alias("_order"))
    line = transactions.select(KEY, F.col("id").alias("item_id"), F.lit(True).alias("_line"))
    joined = ids.join(box, [KEY, "item_id"], "left").join(row, [KEY, "item_id"], "left").join(line, [KEY, "item_id"], "left")
    kind = F.when(F.col("_receipt").isNotNull(), "receipt_region").when(F.col("_order").isNotNull(), "order_row").when(F.col("_line"), "bank_line").otherwise("not_found")
    return joined.select(KEY, "item_id", kind.alias("kind"), F.coalesce("_receipt", "_order").alias("parent_id"), F.when(F.col("_receipt").isNotNull(), F.col("bbox")).alias("bbox"))


def members(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """The household each user works in: earliest membership, then household id."""
    first = memberships.groupBy("user_id").agg(F.min(F.struct("created_at", KEY, "role")).alias("m"))
    return users.join(first, "user_id", "left").select("user_id", "email", "display_name", F.col("m.household_id").alias(KEY), F.col("m.role").alias("role"))


def refresh_profiles(users: DataFrame, identities: DataFrame) -> DataFrame:
    """A sign-in with another e-mail address rewrites the stored profile."""
    seen = identities.select("user_id", F.col("email").alias("_email"), F.col("display_name").alias("_name"))
    moved = F.col("_email").isNotNull() & ~F.col("_email").eqNullSafe(F.col("email"))
    return users.join(seen, "user_id", "left").select(
        "user_id", F.when(moved, F.col("_email")).otherwise(F.col("email")).alias("email"),
        F.when(moved, F.col("_name")).otherwise(F.col("display_name")).alias("display_name"),
    )

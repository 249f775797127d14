"""Which bank line could have paid which receipt or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.config import ReconcileConfig, RECONCILE
from centwise.functions.dates import day_number, days_between
from centwise.functions.similarity import comparable
from centwise.operators.blocks import blocks, members
from centwise.operators.cells import cell, touched
from centwise.operators.names import similar_names
from centwise.storage import cut

KEY = "household_id"


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _debits(bank: DataFrame) -> DataFrame:
    return bank.filter((F.col("direction") == "debit") & F.col("posted_date").isNotNull()).select(
        KEY,
        F.col("id").alias("transaction_id"),
        "posted_date",
        F.abs("amount_cents").alias("bank_cents"),
        F.col("normalized_merchant").alias("bank_merchant"),
        comparable(F.col("normalized_merchant")).alias("right_name"),
        optional(bank, "last_four").alias("bank_last4"),
    )


def _scorable(receipts: DataFrame) -> DataFrame:
    """Receipts with a non-zero total and a date; the rest are never scored."""
    merchant = F.when(F.col("store") != "", F.col("store"))
    return receipts.filter(F.col("total_cents").isNotNull() & (F.col("total_cents") != 0) & F.col("purchased_at").isNotNull()).select(
        KEY,
        F.col("id").alias("receipt_id"),
        merchant.alias("receipt_merchant"),
        "purchased_at",
        "total_cents",
        comparable(F.coalesce(merchant, F.lit(""))).alias("left_name"),
        optional(receipts, "payment_last4").alias("receipt_last4"),
    )


def name_pairs(bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """Receipt and debit names that are alike; for callers that look for candidates more than once."""
    return similar_names(_scorable(receipts), _debits(bank), cfg.merchant_cutoff)


def receipt_candidates(bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """Receipt–debit pairs inside the amount band, the date window and the name cutoff, with their score."""
    return _receipt_edges(_debits(bank), _scorable(receipts), name_pairs(bank, receipts, cfg), cfg)


def receipt_blocks(bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig = RECONCILE, names: DataFrame | None = None) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """``receipt_candidates`` between blocks of equal receipts and of equal debits, and the blocks' members (receipts, debits)."""
    return _block_edges(_receipt_edges, bank, receipts, cfg, names)


def _block_edges(edges, bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig, names: DataFrame | None) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    debits, slips = _debits(bank), _scorable(receipts)
    many_debits, many_slips = cut(blocks(debits, "transaction_id", "_bn"), "debits"), cut(blocks(slips, "receipt_id", "_sn"), "slips")
    names = name_pairs(bank, receipts, cfg) if names is None else names
    return edges(many_debits, many_slips, names, cfg), (members(slips, many_slips, "receipt_id", "_sn"), members(debits, many_debits, "transaction_id", "_bn"))


def _receipt_edges(debits: DataFrame, slips: DataFrame, names: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    tol, win = cfg.tip_tolerance_cents, cfg.receipt_window_days
    left = (
        slips.join(names, [KEY, "left_name"])
        .withColumn("day_cell", F.explode(touched(day_number(F.col("purchased_at")), win)))
        .withColumn("money_cell", F.explode(touched(F.col("total_cents"), tol)))
    )
    right = debits.withColumn("day_cell", cell(day_number(F.col("posted_date")), win)).withColumn("money_cell", cell(F.col("bank_cents"), tol))
    diff = F.abs(F.col("total_cents") - F.col("bank_cents"))
    days = days_between(F.col("posted_date"), F.col("purchased_at"))
    amount_score = F.lit(1.0) if tol == 0 else F.lit(1.0) - F.col("amount_diff") / F.lit(float(tol))
    date_score = F.lit(1.0) if win == 0 else F.lit(1.0) - F.col("date_diff") / F.lit(float(win))
    both4 = F.col("receipt_last4").isNotNull() & (F.col("receipt_last4") != "") & F.col("bank_last4").isNotNull() & (F.col("bank_last4") != "")
    last4 = F.when(both4, F.when(F.col("receipt_last4") == F.col("bank_last4"), 1.0).otherwise(0.0)).otherwise(0.5)
    return (
        left.join(right, [KEY, "right_name", "day_cell", "money_cell"])
        .withColumn("amount_diff", diff)
        .withColumn("date_diff", days)
        .filter((F.col("amount_diff") <= tol) & (F.col("date_diff") <= win))
        .withColumn(
            "confidence",
            F.col("sim") * F.lit(0.4) + amount_score * F.lit(0.3) + date_score * F.lit(0.2) + last4 * F.lit(0.1),
        )
        .drop("left_name", "right_name", "day_cell", "money_cell")
    )


def partial_blocks(bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig = RECONCILE, names: DataFrame | None = None) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """``partial_candidates`` between blocks, and the blocks' members (receipts, debits)."""
    return _block_edges(_partial_edges, bank, receipts, cfg, names)


def partial_candidates(bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """Pairs where the bank line pays less than the receipt; the gap would come from credit."""
    return _partial_edges(_debits(bank), _scorable(receipts), name_pairs(bank, receipts, cfg), cfg)


def _partial_edges(debits: DataFrame, slips: DataFrame, names: DataFrame, cfg: ReconcileConfig) -> DataFrame:
    win = cfg.receipt_window_days
    left = slips.join(names, [KEY, "left_name"]).withColumn("day_cell", F.explode(touched(day_number(F.col("purchased_at")), win)))
    right = debits.withColumn("day_cell", cell(day_number(F.col("posted_date")), win))
    date_score = F.lit(1.0) if win == 0 else F.lit(1.0) - F.col("date_diff") / F.lit(float(win))
    return (
        left.join(right, [KEY, "right_name", "day_cell"])
        .filter(F.col("bank_cents") < F.col("total_cents"))
        .withColumn("date_diff", days_between(F.col("posted_date"), F.col("purchased_at")))
        .filter(F.col("date_diff") <= win)
        .withColumn("gap_cents", F.col("total_cents") - F.col("bank_cents"))
        .withColumn("confidence", F.col("sim") * F.lit(0.6) + date_score * F.lit(0.4))
        .drop("left_name", "right_name", "day_cell")
    )


def retailer_debits(bank: DataFrame) -> DataFrame:
    return bank.filter(
        (F.col("direction") == "debit") & F.upper("normalized_merchant").contains("AMAZON") & F.col("posted_date").isNotNull()
    ).select(
        KEY,
        F.col("id").alias("transaction_id"),
        "posted_date",
        F.abs("amount_cents").alias("bank_cents"),
        F.col("normalized_merchant").alias("bank_merchant"),
    )


def payable_orders(orders: DataFrame) -> DataFrame:
    return orders.filter((F.col("order_total_cents") > 0) & F.col("order_date").isNotNull()).select(
        KEY, F.col("id").alias("order_id"), "external_order_id", "order_date", "order_total_cents"
    )


def order_direct(bank: DataFrame, orders: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """One best retailer debit per order: least amount difference, then days, then id."""
    tol, win = cfg.tip_tolerance_cents, cfg.order_window_days
    left = (
        payable_orders(orders)
        .withColumn("day_cell", F.explode(touched(day_number(F.col("order_date")), win)))
        .withColumn("money_cell", F.explode(touched(F.col("order_total_cents"), tol)))
    )
    right = (
        retailer_debits(bank)
        .withColumn("day_cell", cell(day_number(F.col("posted_date")), win))
        .withColumn("money_cell", cell(F.col("bank_cents"), tol))
    )
    amount_score = F.lit(1.0) if tol == 0 else F.lit(1.0) - F.col("amount_diff") / F.lit(float(tol))
    date_score = F.lit(1.0) if win == 0 else F.lit(1.0) - F.col("date_diff") / F.lit(float(win))
    pairs = (
        left.join(right, [KEY, "day_cell", "money_cell"])
        .withColumn("amount_diff", F.abs(F.col("bank_cents") - F.col("order_total_cents")))
        .withColumn("date_diff", days_between(F.col("posted_date"), F.col("order_date")))
        .filter((F.col("amount_diff") <= tol) & (F.col("date_diff") <= win))
    )
    best = F.min(F.struct("amount_diff", "date_diff", "transaction_id", "bank_cents", "posted_date", "bank_merchant")).alias("best")
    keys = [KEY, "order_id", "external_order_id", "order_date", "order_total_cents"]
    return (
        pairs.groupBy(*keys).agg(best).select(*keys, "best.*")
        .withColumn("confidence", amount_score * F.lit(0.6) + date_score * F.lit(0.4))
    )

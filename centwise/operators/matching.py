"""Candidates settled one-to-one and written as match records.

A match record carries household_id, match_id, type, transaction_id,
transaction_ids (all lines of a split charge), order_id, order_item_id,
receipt_id, credit_id, confidence, rationale, status and confirmed_by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.config import ReconcileConfig, RECONCILE
from centwise.functions.money import route
from centwise.functions.text import filled
from centwise.operators.assign import greedy_pairs, greedy_sets
from centwise.operators.candidates import KEY, order_direct, receipt_blocks
from centwise.operators.split import order_split
from centwise.storage import cut

MATCH_FIELDS = {
    "household_id": "string", "match_id": "string", "type": "string", "transaction_id": "string",
    "transaction_ids": "array<string>", "order_id": "string", "order_item_id": "string", "receipt_id": "string",
    "credit_id": "string", "confidence": "double", "rationale": "string", "status": "string", "confirmed_by": "string",
}


def match_record(df: DataFrame, **fields: Column) -> DataFrame:
    """Project to the match record; fields not given are taken by name or null."""

    def value(name: str, kind: str) -> Column:
        if name in fields:
            return fields[name].cast(kind).alias(name)
        if name in df.columns:
            return F.col(name).cast(kind).alias(name)
        return F.lit(None).cast(kind).alias(name)

    return df.select(*[value(n, k) for n, k in MATCH_FIELDS.items()])


def line_ids() -> Column:
    return F.coalesce("transaction_ids", F.when(F.col("transaction_id").isNotNull(), F.array("transaction_id")), F.array().cast("array<string>"))


def _iso(name: str) -> Column:
    return F.col(name).cast("date").cast("string")


def match_receipts(bank: DataFrame, receipts: DataFrame, cfg: ReconcileConfig = RECONCILE, names: DataFrame | None = None) -> DataFrame:
    edges, members = receipt_blocks(bank, receipts, cfg, names)
    sized = edges.withColumnsRenamed({"_sn": "_ln", "_bn": "_rn"})
    won = greedy_pairs(sized, "receipt_id", "transaction_id", [-F.col("confidence")], members)
    seen4 = (F.coalesce("receipt_last4", F.lit("")) != "") & (F.coalesce("bank_last4", F.lit("")) != "")
    card = (
        F.when(~seen4, "")
        .when(F.col("receipt_last4") == F.col("bank_last4"), F.format_string(", card ****%s matched", "receipt_last4"))
        .otherwise(F.format_string(", card mismatch (receipt ****%s vs bank ****%s)", "receipt_last4", "bank_last4"))
    )
    sim = F.when(F.col("sim") == 1, "1.00").otherwise(F.format_string("%.2f", "sim"))
    text = filled(
        "Receipt {} ({}¢, {}) ↔ Bank {} ({}¢, {}): merchant sim {}, amount diff {}¢, {} day(s) apart{}",
        F.coalesce("receipt_merchant", F.lit("?")), "total_cents", _iso("purchased_at"), "bank_merchant", "bank_cents",
        _iso("posted_date"), sim, "amount_diff", "date_diff", card,
    )
    return match_record(
        won,
        match_id=F.concat(F.lit("receipt_bank-"), "receipt_id", F.lit("-"), "transaction_id"),
        type=F.lit("receipt_bank"), rationale=text, status=route(F.col("confidence"), cfg.auto_link_threshold),
    )


def order_candidates(bank: DataFrame, orders: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """One candidate per order: its best direct line, else its split charge."""
    direct = cut(order_direct(bank, orders, cfg), "direct")
    split = order_split(bank, orders, direct, cfg)
    one = filled(
        "Order {} ({}¢, {}) ↔ Bank {} ({}¢, {}): amount diff {}¢, {} day(s) apart",
        "external_order_id", "order_total_cents", _iso("order_date"), "bank_merchant", "bank_cents", _iso("posted_date"), "amount_diff", "date_diff",
    )
    parts = F.array_join(F.transform("chosen", lambda x: F.format_string("%s(%d¢)", x["transaction_id"], x["bank_cents"])), " + ")
    many = F.format_string(
        "Order %s (%d¢, %s) → split shipment: [%s] = %d¢", "external_order_id", "order_total_cents", _iso("order_date"), parts, "order_total_cents",
    )
    return direct.select(
        KEY, "order_id", F.array("transaction_id").alias("transaction_ids"), "confidence",
        F.lit("order_bank").alias("type"), one.alias("rationale"),
    ).unionByName(split.select(
        KEY, "order_id", "transaction_ids", "confidence", F.lit("order_bank_split").alias("type"), many.alias("rationale"),
    ))


def match_orders(bank: DataFrame, orders: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    won = greedy_sets(order_candidates(bank, orders, cfg), "order_id", "transaction_ids", [-F.col("confidence"), F.col("order_id")])
    return match_record(
        won,
        match_id=F.concat(F.col("type"), F.lit("-"), "order_id", F.lit("-"), F.array_join("transaction_ids", "+")),
        transaction_id=F.get("transaction_ids", F.lit(0)), status=route(F.col("confidence"), cfg.auto_link_threshold),
    )


def apply_decisions(matches: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Honour confirmed links: they win, rivals go, and missing pairs are added.

    ``confirmed`` has one row per transaction with a receipt_id or an order_id;
    a row naming neither is ignored.
    """
    said = confirmed.filter(F.col("receipt_id").isNotNull() | F.col("order_id").isNotNull()).select(
        KEY, F.col("transaction_id").alias("_tx"), F.col("receipt_id").alias("_receipt"), F.col("order_id").alias("_order")
    )
    spoken = (
        matches.select(KEY, "match_id", F.posexplode(line_ids()).alias("_pos", "_tx"))
        .join(said, [KEY, "_tx"])
        .groupBy(KEY, "match_id").agg(F.min(F.struct("_pos", "_tx", "_receipt", "_order")).alias("_said"))
    )
    # rivals are found among ids alone, so that the records, which are wide, are dealt once
    by_receipt = matches.select(KEY, "match_id", "receipt_id").join(said.select(KEY, F.col("_receipt").alias("receipt_id")), [KEY, "receipt_id"], "left_semi")
    by_order = matches.select(KEY, "match_id", "order_id").join(said.select(KEY, F.col("_order").alias("order_id")), [KEY, "order_id"], "left_semi")
    rivals = by_receipt.select(KEY, "match_id").union(by_order.select(KEY, "match_id")).distinct().withColumn("_taken", F.lit(True))
    labelled = matches.join(spoken, [KEY, "match_id"], "left").join(rivals, [KEY, "match_id"], "left")
    decided = F.col("_said").isNotNull()
    the_pair = F.coalesce(F.col("_said._receipt") == F.col("receipt_id"), F.lit(False)) | F.coalesce(F.col("_said._order") == F.col("order_id"), F.lit(False))
    kept = labelled.filter(F.when(decided, the_pair).otherwise(F.col("_taken").isNull()))
    honoured = kept.filter(decided).select(KEY, F.col("_said._tx").alias("_tx"))
    out = match_record(
        kept,
        confidence=F.when(decided, 1.0).otherwise(F.col("confidence")),
        status=F.when(decided, "auto_linked").otherwise(F.col("status")),
        confirmed_by=F.when(decided, "human").otherwise(F.col("confirmed_by")),
        rationale=F.when(decided, F.concat("rationale", F.lit("; confirmed by human"))).otherwise(F.col("rationale")),
    )
    missing = said.join(honoured, [KEY, "_tx"], "left_anti")
    by_receipt = F.col("_receipt").isNotNull()
    kind = F.when(by_receipt, "receipt_bank").otherwise("order_bank")
    added = match_record(
        missing,
        match_id=F.concat_ws("-", kind, F.coalesce("_receipt", "_order"), "_tx"),
        type=kind, transaction_id=F.col("_tx"), transaction_ids=F.when(~by_receipt, F.array("_tx")),
        receipt_id=F.col("_receipt"), order_id=F.when(~by_receipt, F.col("_order")),
        confidence=F.lit(1.0), rationale=F.lit("Confirmed by human"), status=F.lit("auto_linked"), confirmed_by=F.lit("human"),
    )
    return out.unionByName(added)


def first_manual_links(matches: DataFrame) -> DataFrame:
    """Confirmed links from stored rows: the first anchored manual row per transaction, by match id."""
    anchored = matches.filter((F.col("status") == "manual") & (F.col("receipt_id").isNotNull() | F.col("order_id").isNotNull()))
    first = anchored.groupBy(KEY, "transaction_id").agg(F.min(F.struct("id", "receipt_id", "order_id")).alias("m"))
    return first.select(
        KEY, "transaction_id", F.col("m.receipt_id").alias("receipt_id"),
        F.when(F.col("m.receipt_id").isNull(), F.col("m.order_id")).alias("order_id"),
    )

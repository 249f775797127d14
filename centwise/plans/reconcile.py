"""The whole reconciliation, for all households in one job."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from centwise.config import ReconcileConfig, RECONCILE
from centwise.operators.candidates import name_pairs
from centwise.operators.matching import apply_decisions, line_ids, match_orders, match_receipts
from centwise.operators.merge import event_items, merge_counted
from centwise.operators.refunds import card_refunds, credit_refunds, partial_payments
from centwise.sources.tables import Inputs
from centwise.storage import cut

KEY = "household_id"


@dataclass(frozen=True)
class Ledger:
    """Spend events with their classified items, and the match records behind them."""

    events: DataFrame
    items: DataFrame
    matches: DataFrame
    drawdowns: DataFrame

    @property
    def linked(self) -> DataFrame:
        return self.matches.filter(F.col("status") == "auto_linked")

    @property
    def review(self) -> DataFrame:
        return self.matches.filter(F.col("status") == "review")


def match_all(inputs: Inputs, cfg: ReconcileConfig = RECONCILE, names: DataFrame | None = None) -> DataFrame:
    """Receipt and order matches with human decisions applied. The two matchers do not share claims."""
    found = match_receipts(inputs.bank, inputs.receipts, cfg, names).unionByName(match_orders(inputs.bank, inputs.orders, cfg))
    return cut(apply_decisions(found, inputs.confirmed), "matches")


def reconcile(inputs: Inputs, cfg: ReconcileConfig = RECONCILE, leading: bool = False) -> Ledger:
    """The whole ledger; with ``leading`` its items are the first of each receipt and order, for callers that read an event's first item only."""
    names = cut(name_pairs(inputs.bank, inputs.receipts, cfg), "names")
    found = match_all(inputs, cfg, names)
    accruals = cut(inputs.accruals, "accruals")
    card_matches, card_events = card_refunds(inputs.bank)
    credit_matches, credit_events = credit_refunds(inputs.order_items, inputs.orders, accruals)
    before = found.unionByName(card_matches).unionByName(credit_matches)
    part_matches, part_events, drawdowns = partial_payments(inputs.bank, inputs.receipts, accruals, before, cfg, names)
    # partial payments carry their own events, so they are not merged again
    bought, links = merge_counted(found.filter(F.col("status") == "auto_linked"), inputs.bank, inputs.orders, accruals)
    items = event_items(bought, links, inputs.receipts, inputs.receipt_items, inputs.order_items, leading)
    events = bought.unionByName(card_events).unionByName(credit_events).unionByName(part_events)
    return Ledger(events, items, before.unionByName(part_matches), drawdowns)


def written(ledger: Ledger, *parts: str) -> Ledger:
    """The ledger with the named parts stored once, for callers that read them several times; what is read once or never need not be."""
    return replace(ledger, **{p: cut(getattr(ledger, p), p) for p in parts or ("events", "items", "matches")})


def unmatched(inputs: Inputs, ledger: Ledger) -> DataFrame:
    """Debit lines, receipts and bought order items that no linked match explains: household_id, kind, id."""
    linked = ledger.linked
    lines = linked.select(KEY, F.explode(line_ids()).alias("id"))
    receipts = linked.filter("receipt_id IS NOT NULL").select(KEY, F.col("receipt_id").alias("id"))
    orders = linked.filter("order_id IS NOT NULL").select(KEY, "order_id")
    a = inputs.bank.filter(F.col("direction") == "debit").join(lines, [KEY, "id"], "left_anti").select(KEY, F.lit("bank_line").alias("kind"), "id")
    b = inputs.receipts.join(receipts, [KEY, "id"], "left_anti").select(KEY, F.lit("receipt").alias("kind"), "id")
    c = inputs.order_items.filter(~F.col("is_return")).join(orders, [KEY, "order_id"], "left_anti").select(KEY, F.lit("order_item").alias("kind"), "id")
    return a.unionByName(b).unionByName(c)


def run_summary(inputs: Inputs, ledger: Ledger) -> DataFrame:
    """One row per household: what went in, what was matched, what was left, net spend."""

    def tally(df: DataFrame, name: str, value=None) -> DataFrame:
        return df.select(KEY, F.lit(name).alias("what"), (F.lit(1) if value is None else value).cast("bigint").alias("n"))

    left = unmatched(inputs, ledger)
    parts = [
        tally(inputs.bank, "bank_lines"), tally(inputs.orders, "orders"), tally(inputs.receipts, "receipts"),
        tally(ledger.linked, "matched"), tally(ledger.review, "review"),
        tally(left.filter("kind = 'bank_line'"), "unmatched_bank_lines"),
        tally(left.filter("kind = 'receipt'"), "unmatched_receipts"),
        tally(left.filter("kind = 'order_item'"), "unmatched_order_items"),
        tally(ledger.events, "net_spend_cents", F.col("signed_spend_cents")),
    ]
    names = ["bank_lines", "orders", "receipts", "matched", "review", "unmatched_bank_lines", "unmatched_receipts", "unmatched_order_items", "net_spend_cents"]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    wide = stacked.groupBy(KEY).pivot("what", names).agg(F.sum("n"))
    return wide.select(KEY, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])

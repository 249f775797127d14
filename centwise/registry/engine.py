"""Matching, refunds and the ledger over the household tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from centwise.functions.money import to_pct
from centwise.operators import candidates, matching, refunds, rollup
from centwise.plans import reconcile as engine
from centwise.registry import sql_engine  # noqa: F401  (registers fragments)
from centwise.registry.catalog import query
from centwise.registry.stored import household
from centwise.sources.tables import LazyInputs
from centwise.storage import cut

PCT = "CAST(floor(confidence * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS confidence_pct"


def inputs(spark, d, household_id: str | None = None) -> LazyInputs:
    """The engine's inputs; household tables that a query doesn't use are not derived for it."""
    return LazyInputs(lambda name: household(spark, d, name), household_id)


def pct():
    return to_pct(F.col("confidence")).alias("confidence_pct")


def _matches(df: DataFrame) -> DataFrame:
    return df.select("household_id", "match_id", "type", "transaction_id", F.array_join(matching.line_ids(), "+").alias("lines"), "order_id", "receipt_id", "status", pct())


_MATCH_SQL = "SELECT household_id, match_id, type, transaction_id, array_to_string(ids, '+') AS lines, order_id, receipt_id, status, " + PCT


@query("store_credit_accruals", "SELECT * FROM e_accruals")
def store_credit_accruals(spark, d):
    return inputs(spark, d).accruals


@query("receipt_candidates", f"SELECT household_id, receipt_id, transaction_id, amount_diff, date_diff, {PCT} FROM e_receipt_cand")
def receipt_candidates(spark, d):
    i = inputs(spark, d)
    return candidates.receipt_candidates(i.bank, i.receipts).select("household_id", "receipt_id", "transaction_id", "amount_diff", "date_diff", pct())


@query("receipt_matches", f"{_MATCH_SQL} FROM e_found WHERE type = 'receipt_bank'")
def receipt_matches(spark, d):
    i = inputs(spark, d)
    return _matches(matching.match_receipts(i.bank, i.receipts))


@query("order_direct", f"SELECT household_id, order_id, transaction_id, amount_diff, date_diff, {PCT} FROM e_order_direct")
def order_direct(spark, d):
    i = inputs(spark, d)
    return candidates.order_direct(i.bank, i.orders).select("household_id", "order_id", "transaction_id", "amount_diff", "date_diff", pct())


@query("order_split", f"SELECT household_id, order_id, array_to_string(transaction_ids, '+') AS lines, {PCT} FROM e_order_split")
def order_split(spark, d):
    from centwise.operators.split import order_split as split

    i = inputs(spark, d)
    found = split(i.bank, i.orders, candidates.order_direct(i.bank, i.orders))
    return found.select("household_id", "order_id", F.array_join("transaction_ids", "+").alias("lines"), pct())


@query("order_matches", f"{_MATCH_SQL} FROM e_found WHERE type <> 'receipt_bank'")
def order_matches(spark, d):
    i = inputs(spark, d)
    return _matches(matching.match_orders(i.bank, i.orders))


@query("match_rationales", """
SELECT f.household_id, f.match_id, 'Receipt ' || coalesce(nullif(r.store, ''), '?') || ' (' || r.total_cents || '¢, ' || strftime(r.purchased_at, '%Y-%m-%d') || ') ↔ Bank ' || b.normalized_merchant || ' (' || abs(b.amount_cents) || '¢, '
    || strftime(b.posted_date, '%Y-%m-%d') || '): merchant sim ' || printf('%.2f', c.sim) || ', amount diff ' || c.amount_diff || '¢, ' || c.date_diff || ' day(s) apart' AS rationale
FROM e_found f JOIN v_receipts r ON r.id = f.receipt_id JOIN v_bank b ON b.id = f.transaction_id JOIN e_receipt_cand c ON c.receipt_id = f.receipt_id AND c.transaction_id = f.transaction_id WHERE f.type = 'receipt_bank'
UNION ALL
SELECT f.household_id, f.match_id, 'Order ' || o.external_order_id || ' (' || o.order_total_cents || '¢, ' || strftime(o.order_date, '%Y-%m-%d') || ') ↔ Bank ' || b.normalized_merchant || ' (' || abs(b.amount_cents) || '¢, '
    || strftime(b.posted_date, '%Y-%m-%d') || '): amount diff ' || d.amount_diff || '¢, ' || d.date_diff || ' day(s) apart'
FROM e_found f JOIN v_orders o ON o.id = f.order_id JOIN e_order_direct d ON d.order_id = f.order_id JOIN v_bank b ON b.id = d.transaction_id WHERE f.type = 'order_bank'
UNION ALL
SELECT household_id, 'refund_card-' || id, 'Bank CREDIT ' || normalized_merchant || ' (' || amount_cents || '¢, ' || strftime(posted_date, '%Y-%m-%d') || '): card refund' FROM v_bank WHERE direction = 'credit'""")
def match_rationales(spark, d):
    i = inputs(spark, d)
    orders = matching.match_orders(i.bank, i.orders).filter("type = 'order_bank'")
    found = matching.match_receipts(i.bank, i.receipts).unionByName(orders).unionByName(refunds.card_refunds(i.bank)[0])
    return found.select("household_id", "match_id", "rationale")


@query("decided_matches", f"{_MATCH_SQL}, confirmed_by FROM e_decided")
def decided_matches(spark, d):
    m = engine.match_all(inputs(spark, d))
    return m.select("household_id", "match_id", "type", "transaction_id", F.array_join(matching.line_ids(), "+").alias("lines"), "order_id", "receipt_id", "status", pct(), "confirmed_by")


@query("first_manual_links", """
SELECT household_id, transaction_id, receipt_id, CASE WHEN receipt_id IS NULL THEN order_id END AS order_id FROM v_matches
WHERE status = 'manual' AND (receipt_id IS NOT NULL OR order_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY household_id, transaction_id ORDER BY id) = 1""")
def first_manual_links(spark, d):
    return matching.first_manual_links(household(spark, d, "matches"))


@query("card_refunds", "SELECT household_id, event_id, signed_spend_cents, occurred_on, transaction_id FROM e_events WHERE event_id LIKE 'refund-card-%'")
def card_refunds(spark, d):
    return refunds.card_refunds(inputs(spark, d).bank)[1].select("household_id", "event_id", "signed_spend_cents", "occurred_on", "transaction_id")


@query("return_accrual_links", "SELECT household_id, order_id, order_item_id, kind, refund_cents, accrual_id FROM e_linked")
def return_accrual_links(spark, d):
    i = inputs(spark, d)
    linked = refunds.link_accruals(refunds.credit_returns(i.order_items), i.accruals)
    return linked.select("household_id", "order_id", "order_item_id", "kind", "refund_cents", "accrual_id")


@query("store_credit_refunds", "SELECT * EXCLUDE (funded_by, transaction_id, receipt_id) FROM e_events WHERE event_id LIKE 'refund-sc-%'")
def store_credit_refunds(spark, d):
    i = inputs(spark, d)
    return refunds.credit_refunds(i.order_items, i.orders, i.accruals)[1].drop("funded_by", "transaction_id", "receipt_id")


@query("credit_balance", "SELECT * FROM e_balance")
def credit_balance(spark, d):
    return refunds.credit_balance(inputs(spark, d).accruals)


def _partials(spark, d):
    i = inputs(spark, d)
    found = engine.match_all(i)
    return refunds.partial_payments(i.bank, i.receipts, cut(i.accruals, "accruals"), found.unionByName(refunds.card_refunds(i.bank)[0]))


@query("partial_payments", f"""SELECT household_id, match_id, transaction_id, receipt_id, credit_id, status, {PCT}
FROM e_all_matches WHERE type = 'store_credit_drawdown'""")
def partial_payments(spark, d):
    return _partials(spark, d)[0].select("household_id", "match_id", "transaction_id", "receipt_id", "credit_id", "status", pct())


@query("credit_drawdowns", """
SELECT household_id, 'drawdown-' || transaction_id || '-' || receipt_id AS drawdown_id, kind, -gap_cents AS amount_cents, posted_date AS occurred_on, 'partial_payment' AS reason
FROM e_drawn WHERE kind IS NOT NULL""")
def credit_drawdowns(spark, d):
    return _partials(spark, d)[2]


@query("ledger_events", "SELECT * FROM e_events")
def ledger_events(spark, d):
    return engine.reconcile(inputs(spark, d)).events


@query("ledger_items", "SELECT household_id, event_id, receipt_item_id, order_item_id, merchant, description, category, rationale FROM e_items")
def ledger_items(spark, d):
    return engine.reconcile(inputs(spark, d)).items.drop("item_rank", "source")


@query("ledger_matches", f"""SELECT household_id, match_id, type, transaction_id, array_to_string(ids, '+') AS lines, order_id, order_item_id, receipt_id, credit_id, status, confirmed_by, {PCT}
FROM e_all_matches""")
def ledger_matches(spark, d):
    m = engine.reconcile(inputs(spark, d)).matches
    return m.select("household_id", "match_id", "type", "transaction_id", F.array_join(matching.line_ids(), "+").alias("lines"), "order_id", "order_item_id", "receipt_id", "credit_id", "status", "confirmed_by", pct())


@query("ledger_rollup", "SELECT * FROM e_rollup")
def ledger_rollup(spark, d):
    ledger = engine.reconcile(inputs(spark, d), leading=True)
    return rollup.ledger_rollup(rollup.event_cells(ledger.events, ledger.items))


@query("ledger_rollup_members", "SELECT household_id, category, month, event_id FROM e_cells")
def ledger_rollup_members(spark, d):
    ledger = engine.reconcile(inputs(spark, d), leading=True)
    return rollup.event_cells(ledger.events, ledger.items).select("household_id", "category", "month", "event_id")


@query("net_spend", "SELECT household_id, CAST(sum(signed_spend_cents) AS BIGINT) AS net_spend_cents FROM e_events GROUP BY 1")
def net_spend(spark, d):
    return rollup.net_spend(engine.reconcile(inputs(spark, d)).events)


@query("scoped_net_spend", "SELECT household_id, CAST(sum(signed_spend_cents) AS BIGINT) AS net_spend_cents FROM e_events WHERE household_id = (SELECT arg_max(household_id, {n: n, h: household_id}) FROM (SELECT household_id, count(*) AS n FROM v_tx GROUP BY 1)) GROUP BY 1")
def scoped_net_spend(spark, d):
    """The engine run for one household alone, the one with the most bank lines."""
    busiest = household(spark, d, "transactions").groupBy("household_id").count().orderBy(F.desc("count"), F.desc("household_id")).first()
    return rollup.net_spend(engine.reconcile(inputs(spark, d, busiest["household_id"])).events)


@query("unmatched_sets", "SELECT * FROM e_unmatched")
def unmatched_sets(spark, d):
    i = inputs(spark, d)
    return engine.unmatched(i, engine.reconcile(i))


@query("run_summary", """
SELECT household_id, coalesce(b, 0) AS bank_lines, coalesce(o, 0) AS orders, coalesce(r, 0) AS receipts, coalesce(m, 0) AS matched, coalesce(q, 0) AS review,
  coalesce(ub, 0) AS unmatched_bank_lines, coalesce(ur, 0) AS unmatched_receipts, coalesce(uo, 0) AS unmatched_order_items, coalesce(n, 0) AS net_spend_cents
FROM (SELECT household_id, count(*) AS b FROM v_bank GROUP BY 1)
FULL JOIN (SELECT household_id, count(*) AS o FROM v_orders GROUP BY 1) USING (household_id)
FULL JOIN (SELECT household_id, count(*) AS r FROM v_receipts GROUP BY 1) USING (household_id)
FULL JOIN (SELECT household_id, count(*) FILTER (status = 'auto_linked') AS m, count(*) FILTER (status = 'review') AS q FROM e_all_matches GROUP BY 1) USING (household_id)
FULL JOIN (SELECT household_id, count(*) FILTER (kind = 'bank_line') AS ub, count(*) FILTER (kind = 'receipt') AS ur, count(*) FILTER (kind = 'order_item') AS uo FROM e_unmatched GROUP BY 1) USING (household_id)
FULL JOIN (SELECT household_id, CAST(sum(signed_spend_cents) AS BIGINT) AS n FROM e_events GROUP BY 1) USING (household_id)""")
def run_summary(spark, d):
    i = inputs(spark, d)
    return engine.run_summary(i, engine.written(engine.reconcile(i), "matches"))

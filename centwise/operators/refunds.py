"""Money coming back: card refunds, returns to credit, and receipts part-paid with credit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from centwise.config import ReconcileConfig, RECONCILE
from centwise.functions.money import bank_to_spend, route
from centwise.functions.text import filled
from centwise.operators.assign import greedy_pairs
from centwise.operators.candidates import KEY, partial_blocks
from centwise.operators.cells import cell, touched
from centwise.operators.matching import line_ids, match_record
from centwise.operators.ordered import running
from centwise.storage import cut

# The order in which kinds of credit are spent.
CREDIT_KINDS = ["gift_card", "store_credit", "account_balance"]
ACCRUAL_SLACK_CENTS = 100
EVENT_FIELDS = {
    "household_id": "string", "event_id": "string", "signed_spend_cents": "bigint", "occurred_on": "date",
    "funded_by": "string", "transaction_id": "string", "order_id": "string", "receipt_id": "string",
}


def event_record(df: DataFrame, **fields) -> DataFrame:
    def value(name: str, kind: str):
        if name in fields:
            return fields[name].cast(kind).alias(name)
        return F.lit(None).cast(kind).alias(name)

    return df.select(KEY, *[value(n, k) for n, k in EVENT_FIELDS.items() if n != KEY])


def card_refunds(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every bank credit is a card refund: (matches, events)."""
    credit = bank.filter(F.col("direction") == "credit")
    text = filled("Bank CREDIT {} ({}¢, {}): card refund", "normalized_merchant", "amount_cents", F.col("posted_date").cast("date"))
    matches = match_record(
        credit, match_id=F.concat(F.lit("refund_card-"), "id"), type=F.lit("refund_card"), transaction_id=F.col("id"),
        confidence=F.lit(0.9), rationale=text, status=F.lit("auto_linked"),
    )
    events = event_record(
        credit, event_id=F.concat(F.lit("refund-card-"), "id"), signed_spend_cents=bank_to_spend(F.col("amount_cents")),
        occurred_on=F.col("posted_date"), funded_by=F.lit("bank"), transaction_id=F.col("id"),
    )
    return matches, events


def credit_returns(order_items: DataFrame) -> DataFrame:
    return order_items.filter(F.col("is_return") & F.col("refund_destination").isNotNull() & (F.col("refund_destination") != "card")).select(
        KEY, "order_id", F.col("id").alias("order_item_id"), F.col("refund_destination").alias("kind"), "description", "amount_cents",
        F.abs("amount_cents").alias("refund_cents"),
    )


def link_accruals(returns: DataFrame, accruals: DataFrame) -> DataFrame:
    """Each return with the accrual that paid it, or null.

    Same order, item and kind first; then same order and kind; then the nearest
    amount of that kind within a hundred cents.  Ties go to the lower accrual id.
    Equal amounts are reduced to their lowest id before anything is joined.
    """
    lowest = F.min("id")
    exact = accruals.groupBy(KEY, "order_id", "order_item_id", "kind").agg(lowest.alias("by_item"))
    same_order = accruals.filter("order_id IS NOT NULL").groupBy(KEY, "order_id", "kind").agg(lowest.alias("by_order"))
    amounts = accruals.groupBy(KEY, "kind", "amount_cents").agg(lowest.alias("accrual_id")).withColumnRenamed("amount_cents", "accrual_cents")
    wanted = returns.select(KEY, "kind", "refund_cents").distinct()
    near = (
        wanted.withColumn("c", F.explode(touched(F.col("refund_cents"), ACCRUAL_SLACK_CENTS)))
        .join(amounts.withColumn("c", cell(F.col("accrual_cents"), ACCRUAL_SLACK_CENTS)), [KEY, "kind", "c"])
        .withColumn("gap", F.abs(F.col("accrual_cents") - F.col("refund_cents")))
        .filter(F.col("gap") <= ACCRUAL_SLACK_CENTS)
        .groupBy(KEY, "kind", "refund_cents").agg(F.min(F.struct("gap", "accrual_id")).alias("n"))
        .select(KEY, "kind", "refund_cents", F.col("n.accrual_id").alias("by_amount"))
    )
    return (
        returns.join(exact, [KEY, "order_id", "order_item_id", "kind"], "left")
        .join(same_order, [KEY, "order_id", "kind"], "left")
        .join(near, [KEY, "kind", "refund_cents"], "left")
        .withColumn("accrual_id", F.coalesce("by_item", "by_order", "by_amount"))
        .drop("by_item", "by_order", "by_amount")
    )


def credit_refunds(order_items: DataFrame, orders: DataFrame, accruals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns paid to credit: (matches, events)."""
    dated = orders.select(KEY, F.col("id").alias("order_id"), "order_date")
    linked = link_accruals(credit_returns(order_items), accruals).join(dated, [KEY, "order_id"])
    found = F.col("accrual_id").isNotNull()
    text = F.when(found, filled("Return {} ({}¢) linked to {} accrual {}", "description", "amount_cents", "kind", "accrual_id")).otherwise(
        filled("Return {} ({}¢) — no matching accrual; {} refund assumed", "description", "amount_cents", "kind")
    )
    matches = match_record(
        linked, match_id=F.concat(F.lit("store_credit_refund-"), "order_id", F.lit("-"), "order_item_id"), type=F.lit("store_credit_refund"),
        credit_id=F.col("accrual_id"), confidence=F.when(found, 0.95).otherwise(0.75), rationale=text, status=F.lit("auto_linked"),
    )
    events = event_record(
        linked, event_id=F.concat(F.lit("refund-sc-"), "order_id", F.lit("-"), "order_item_id"), signed_spend_cents=-F.col("refund_cents"),
        occurred_on=F.col("order_date"), funded_by=F.lit("store_credit"), order_id=F.col("order_id"),
    )
    return matches, events


def credit_balance(accruals: DataFrame) -> DataFrame:
    """Balance per (household, kind); a negative one is overdrawn."""
    return accruals.groupBy(KEY, "kind").agg(F.sum("amount_cents").alias("balance_cents"))


def _draw(pairs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` that one kind of credit covers, and the others.

    In order, a pair is covered if what is left of the household's balance is
    enough.  With running sums that is every pair up to the first that does not
    fit.  What is left then only shrinks, so pairs above it are out for good, and
    the rest is summed again: one pass where a balance covers all pairs it could
    cover, one more for each time that a pair does not fit but a later one might.
    """
    order = [F.desc("confidence"), F.col("transaction_id"), F.col("receipt_id")]
    drawn, rest, left = None, None, pairs.withColumn("_left", F.col(kind))
    while True:
        fits = F.col("gap_cents") <= F.col("_left")
        out = left.filter(~fits).select(*pairs.columns)
        rest = out if rest is None else rest.unionByName(out)
        tried = cut(running(left.filter(fits), [KEY], order, _total=F.col("gap_cents")), "tried")
        enough = F.col("_total") <= F.col("_left")
        found = tried.filter(enough).select(*pairs.columns)
        drawn = found if drawn is None else drawn.unionByName(found)
        if tried.filter(~enough).isEmpty():
            return drawn, rest
        spent = tried.filter(enough).groupBy(KEY).agg(F.max("_total").alias("_spent"))
        left = tried.filter(~enough).join(spent, KEY).withColumn("_left", F.col("_left") - F.col("_spent")).drop("_total", "_spent")


def spend_credit(pairs: DataFrame, accruals: DataFrame) -> DataFrame:
    """``pairs`` with the credit kind each one draws on (null: not covered).

    By falling confidence, then ids, each pair draws on the first kind whose
    balance still covers its gap.  Which pairs a kind covers depends on that kind
    and those before it only, so kinds are drawn on one after another.
    """
    wide = credit_balance(accruals).groupBy(KEY).pivot("kind", CREDIT_KINDS).agg(F.first("balance_cents"))
    wide = wide.select(KEY, *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in CREDIT_KINDS])
    in_play = pairs.join(wide, KEY).filter(F.greatest(*CREDIT_KINDS) >= F.col("gap_cents"))
    ident = [KEY, "transaction_id", "receipt_id"]
    rest = cut(in_play.select(*ident, "gap_cents", "confidence", *CREDIT_KINDS), "gaps")
    covered = None
    for kind in CREDIT_KINDS:
        drawn, rest = _draw(rest, kind)
        found = drawn.select(*ident, F.lit(kind).alias("kind"))
        covered = found if covered is None else covered.unionByName(found)
    return pairs.join(covered, ident, "left")


def partial_payments(
    bank: DataFrame, receipts: DataFrame, accruals: DataFrame, matches: DataFrame, cfg: ReconcileConfig = RECONCILE, names: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receipts part-paid from credit: (matches, events, drawdowns).

    ``matches`` are all earlier matches, whatever their status: their lines and
    receipts are out of the pool.  ``names`` are the name pairs of all lines and
    receipts, where the caller has them.
    """
    used_lines = matches.select(KEY, F.explode(line_ids()).alias("id"))
    used_receipts = matches.filter("receipt_id IS NOT NULL").select(KEY, F.col("receipt_id").alias("id"))
    free_lines = bank.join(used_lines, [KEY, "id"], "left_anti")
    free_receipts = receipts.join(used_receipts, [KEY, "id"], "left_anti")
    edges, (slips, debits) = partial_blocks(free_lines, free_receipts, cfg, names)
    sized = edges.withColumnsRenamed({"_bn": "_ln", "_sn": "_rn"})
    pairs = greedy_pairs(sized, "transaction_id", "receipt_id", [-F.col("confidence")], (debits, slips))
    drawn = cut(spend_credit(pairs, accruals), "drawn")
    largest = accruals.filter(F.col("amount_cents") > 0).groupBy(KEY, "kind").agg(F.min(F.struct(-F.col("amount_cents"), F.col("id").alias("id"))).alias("top"))
    drawn = drawn.join(largest.select(KEY, "kind", F.col("top.id").alias("credit_id")), [KEY, "kind"], "left")
    covered = F.col("kind").isNotNull()
    text = filled("Partial store-credit payment: {} bank {}¢ + store credit {}¢ = receipt {}¢", "bank_merchant", "bank_cents", "gap_cents", "total_cents")
    short = F.concat(text, filled(" — insufficient accrual ({}¢ needed); routed to review", "gap_cents"))
    records = match_record(
        drawn, match_id=F.concat(F.lit("store_credit_drawdown-"), "transaction_id", F.lit("-"), "receipt_id"), type=F.lit("store_credit_drawdown"),
        rationale=F.when(covered, text).otherwise(short),
        status=F.when(covered, route(F.col("confidence"), cfg.auto_link_threshold)).otherwise("review"),
    )
    paid = drawn.filter(covered)
    tail = F.concat("transaction_id", F.lit("-"), "receipt_id")
    events = event_record(
        paid, event_id=F.concat(F.lit("sc-partial-"), tail), signed_spend_cents=F.col("total_cents"), occurred_on=F.col("posted_date"),
        funded_by=F.lit("bank"), transaction_id=F.col("transaction_id"), receipt_id=F.col("receipt_id"),
    )
    drawdowns = paid.select(
        KEY, F.concat(F.lit("drawdown-"), tail).alias("drawdown_id"), "kind", (-F.col("gap_cents")).alias("amount_cents"),
        F.col("posted_date").alias("occurred_on"), F.lit("partial_payment").alias("reason"),
    )
    return records, events, drawdowns

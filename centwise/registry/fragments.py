"""Named SQL fragments from which the check queries are put together.

``compose(sql)`` prefixes a SELECT with the fragments it names, dependencies
first.  This is checking SQL for the driver's other engine; nothing here runs on
Spark.
"""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [n for n in FRAGMENTS if n in words]


def compose(sql: str) -> str:
    order: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in order or name in trail:
            return
        for dep in _needs(FRAGMENTS[name]):
            if dep != name:
                visit(dep, trail + (name,))
        if name not in order:
            order.append(name)

    for n in _needs(sql):
        visit(n, ())
    if not order:
        return sql.strip()
    body = ",\n".join(f"{n} AS (\n{FRAGMENTS[n]}\n)" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH RECURSIVE {body},\n{sql[5:]}"
    return f"WITH RECURSIVE {body}\n{sql}"


# ---------------------------------------------------------------- household views
fragment("v_base", """
SELECT o_orderkey AS k, o_custkey AS custkey,
  'hh-' || lpad(CAST(o_custkey // 10 AS VARCHAR), 9, '0') AS household_id,
  'acct-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS account_id,
  CAST(floor(o_totalprice) AS BIGINT) % 8000 + 200 AS cents,
  o_totalprice AS price, CAST(o_orderdate AS DATE) AS original_date,
  DATE '1998-01-01' + CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 150 AS INTEGER) AS d,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AMAZON' WHEN '2-HIGH' THEN 'COSTCO WHSE' WHEN '3-MEDIUM' THEN 'TRADER JOE S'
    WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'NETFLIX' WHEN 'O' THEN 'SHELL OIL' ELSE 'HOME DEPOT' END
    ELSE CASE o_orderstatus WHEN 'F' THEN 'WALMART' WHEN 'O' THEN 'CVS PHARMACY' ELSE 'TARGET' END END AS store,
  o_orderstatus AS status
FROM orders""")

fragment("v_tx", """
SELECT 'tx-' || lpad(CAST(k AS VARCHAR), 12, '0') || '-' || part AS id, household_id, account_id,
  d + CAST(k % 3 AS INTEGER) AS posted_date, amount_cents,
  CASE WHEN amount_cents < 0 THEN 'debit' ELSE 'credit' END AS direction,
  CASE WHEN store = 'AMAZON' THEN 'AMAZON MKTPL*' || k ELSE store || ' #' || k END AS raw_merchant,
  CASE WHEN store = 'AMAZON' THEN 'AMAZON MKTPL' ELSE store END AS normalized_merchant,
  original_date >= DATE '2001-06-01' AS pending
FROM (
  SELECT *, CAST(CASE WHEN part = 'b' THEN -(cents - cents // 3)
    WHEN store = 'AMAZON' AND price >= 300000 AND price < 430000 THEN -(cents // 3)
    WHEN price >= 470000 THEN cents WHEN price >= 430000 THEN -(cents - cents // 4)
    ELSE -(cents - custkey % 7 * 25) END AS BIGINT) AS amount_cents
  FROM (SELECT *, 'a' AS part FROM v_base UNION ALL
        SELECT *, 'b' AS part FROM v_base WHERE store = 'AMAZON' AND price >= 300000 AND price < 430000))""")

fragment("v_bank", "SELECT id, household_id, account_id, posted_date, amount_cents, direction, normalized_merchant FROM v_tx WHERE NOT pending")

fragment("v_lines", """
SELECT l_orderkey AS k, no AS ln, l_partkey AS partkey, CAST(l_shipdate AS DATE) AS shipped,
  l_quantity AS quantity, l_returnflag AS returnflag, l_linestatus AS linestatus, cents,
  cents * CAST(round(l_discount * 100) AS BIGINT) // 100 AS saving,
  p_name || ' ' || CASE p_type WHEN 'ECONOMY' THEN 'paper towel' WHEN 'SMALL' THEN 'cotton shirt' WHEN 'STANDARD' THEN 'usb-c cable'
    WHEN 'PROMO' THEN 'hardcover atlas' WHEN 'MEDIUM' THEN 'cat litter' ELSE 'garden hose' END AS description,
  CASE p_type WHEN 'ECONOMY' THEN 'household' WHEN 'SMALL' THEN 'clothing' WHEN 'STANDARD' THEN 'electronics'
    WHEN 'PROMO' THEN 'books-media' ELSE 'other' END AS category_id,
  l_returnflag = 'R' AND l_linenumber % 2 = 0 AS is_return
FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 5000 + 50 AS cents,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
          l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS no FROM lineitem)
JOIN part ON l_partkey = p_partkey""")

fragment("v_orders", """
SELECT 'o-' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, household_id, '111-' || lpad(CAST(k AS VARCHAR), 12, '0') AS external_order_id,
  d AS order_date, cents AS order_total_cents FROM v_base WHERE store = 'AMAZON'""")

fragment("v_order_items", """
SELECT 'oi-' || lpad(CAST(k AS VARCHAR), 12, '0') || '-' || ln AS id, 'o-' || lpad(CAST(k AS VARCHAR), 12, '0') AS order_id, household_id,
  strftime(shipped, '%Y-%m-%d') AS shipment_id,
  row_number() OVER (PARTITION BY k, shipped ORDER BY ln) AS item_seq, description,
  CASE WHEN is_return THEN -v_lines.cents ELSE v_lines.cents END AS amount_cents, is_return,
  CASE WHEN is_return THEN CASE WHEN linestatus = 'O' THEN 'store_credit' WHEN quantity >= 25 THEN 'gift_card' ELSE 'card' END END AS refund_destination,
  quantity, shipped
FROM v_lines JOIN v_base USING (k) WHERE store = 'AMAZON'""")

fragment("v_receipt_base", "SELECT * FROM v_base WHERE store IN ('COSTCO WHSE', 'TRADER JOE S', 'WALMART', 'HOME DEPOT', 'CVS PHARMACY')")

fragment("v_receipt_items", """
SELECT 'ri-' || lpad(CAST(k AS VARCHAR), 12, '0') || '-' || ln AS id, 'r-' || lpad(CAST(k AS VARCHAR), 12, '0') AS receipt_id, household_id,
  row_number() OVER (PARTITION BY k ORDER BY ln) AS line_no, 'S' || partkey AS sku, upper(description) AS raw_description,
  CASE WHEN returnflag <> 'N' THEN list_aggregate(list_transform(string_split(description, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') END AS canonical_name,
  CASE WHEN linestatus <> 'O' THEN category_id END AS category_id, quantity, v_lines.cents AS line_price_cents, saving AS discount_cents,
  CASE WHEN returnflag <> 'N' THEN CAST(0.9 AS DOUBLE) END AS name_confidence,
  CASE WHEN linestatus <> 'O' THEN CASE WHEN returnflag = 'A' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END END AS category_confidence,
  returnflag = 'N' OR (linestatus <> 'O' AND returnflag = 'R') AS needs_review
FROM v_lines JOIN v_receipt_base USING (k) WHERE NOT (status = 'P' AND price < 20000)""")

fragment("v_receipts", """
SELECT id, household_id, CASE WHEN status = 'F' THEN 'photo' ELSE 'costco_digital' END AS source,
  CASE WHEN blank THEN '' WHEN status = 'F' THEN store WHEN status = 'O' THEN lower(store) ELSE store || ' 118' END AS store,
  CASE WHEN NOT blank THEN d END AS purchased_at, subtotal AS subtotal_cents,
  CAST(CASE WHEN blank THEN NULL WHEN status = 'F' THEN total_cents - coalesce(subtotal, 0) ELSE 0 END AS BIGINT) AS tax_cents,
  total_cents, 'img-' || lpad(CAST(k AS VARCHAR), 12, '0') AS image_hash, status <> 'F' AS needs_review
FROM (SELECT *, 'r-' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, status = 'P' AND price < 20000 AS blank,
    CASE WHEN status = 'P' AND price < 20000 THEN 0 WHEN price >= 470000 THEN -cents ELSE cents END AS total_cents FROM v_receipt_base)
LEFT JOIN (SELECT receipt_id, CAST(sum(line_price_cents - discount_cents) AS BIGINT) AS subtotal FROM v_receipt_items GROUP BY 1) ON receipt_id = id""")

fragment("v_credit", """
SELECT 'sc-' || id AS id, household_id, refund_destination AS kind, -amount_cents AS amount_cents, shipped AS created_on,
  CASE WHEN quantity < 30 THEN id END AS order_item_id
FROM v_order_items WHERE is_return AND refund_destination <> 'card' AND quantity < 40""")

fragment("v_accounts", """
SELECT 'acct-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, 'hh-' || lpad(CAST(c_custkey // 10 AS VARCHAR), 9, '0') AS household_id,
  c_name AS name, lower(c_mktsegment) AS type, CASE WHEN c_acctbal > 0 THEN 'login-' || c_nationkey END AS login_id FROM customer""")

fragment("v_matches", """
WITH held AS (SELECT *, lpad(CAST(k AS VARCHAR), 12, '0') AS k12,
  CASE WHEN price < 100000 THEN 'pending' WHEN price < 140000 THEN 'manual' WHEN price < 180000 THEN 'rejected' WHEN price < 400000 THEN 'matched' END AS match_status,
  CASE WHEN price < 140000 THEN 'h-' ELSE 'm-' END AS owner FROM v_base WHERE price < 400000)
SELECT owner || ri.id AS id, held.household_id, 'tx-' || k12 || '-a' AS transaction_id, CAST(NULL AS VARCHAR) AS order_item_id, ri.id AS receipt_item_id,
  ri.receipt_id, CAST(NULL AS VARCHAR) AS order_id, match_status AS status, cents % 101 AS confidence, 'receipt_bank' AS method
FROM held JOIN v_receipt_items ri ON ri.receipt_id = 'r-' || k12
UNION ALL
SELECT owner || oi.id, held.household_id, 'tx-' || k12 || '-a', oi.id,
  'ri-' || lpad(CAST(k + 1 AS VARCHAR), 12, '0') || '-' || split_part(oi.id, '-', 3), NULL, oi.order_id, match_status, cents % 101, 'order_bank'
FROM held JOIN v_order_items oi ON oi.order_id = 'o-' || k12 AND NOT oi.is_return""")

fragment("v_decisions", """
WITH b AS (SELECT household_id, price, lpad(CAST(k AS VARCHAR), 12, '0') AS k12 FROM v_base WHERE price < 120000)
SELECT household_id, 'flagged_receipt' AS item_type, 'r-' || k12 AS item_id FROM b WHERE price < 60000
UNION ALL SELECT household_id, 'missing_receipt', 'tx-' || k12 || '-a' FROM b WHERE price < 60000
UNION ALL SELECT household_id, 'sku_resolution', 'ri-' || k12 || '-2' FROM b WHERE price < 60000
UNION ALL SELECT household_id, 'unmatched_txn', 'tx-' || k12 || '-a' FROM b WHERE price >= 60000""")

fragment("v_confirmed", """
SELECT household_id, 'tx-' || lpad(CAST(k AS VARCHAR), 12, '0') || '-a' AS transaction_id,
  CASE WHEN store IN ('COSTCO WHSE', 'TRADER JOE S', 'WALMART', 'HOME DEPOT', 'CVS PHARMACY') THEN 'r-' || lpad(CAST(k AS VARCHAR), 12, '0') END AS receipt_id,
  CASE WHEN store = 'AMAZON' THEN 'o-' || lpad(CAST(k AS VARCHAR), 12, '0') END AS order_id
FROM v_base WHERE price >= 100000 AND price < 140000""")

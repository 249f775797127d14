"""Idempotent load, match sink, read views and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from centwise import derived
from centwise.functions.money import to_pct
from centwise.functions.taxonomy import CATEGORIES
from centwise.operators import load, queue, reads, rollup, sink
from centwise.plans import reconcile as engine
from centwise.registry.catalog import query
from centwise.registry.engine import inputs
from centwise.registry.fragments import fragment
from centwise.registry.stored import household
from centwise.storage import new_path

_CATS = ", ".join("('{}', '{}')".format(i, n) for i, n in CATEGORIES.items())
fragment("q_categories", f"SELECT * FROM (VALUES {_CATS}) AS c(category_id, category)")


def categories(spark):
    return spark.createDataFrame(list(CATEGORIES.items()), "category_id string, category string")


# ---- idempotent load: order lines shipped before 1998 are stored already, the batch is the whole file
_LINE = "l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
fragment("q_line_first", f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) = 1")
fragment("q_line_stored", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'")
fragment("q_line_new", "SELECT * FROM q_line_first WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM q_line_stored)")


def _line_load(spark, d):
    batch = derived.table(spark, d, "lineitem")
    stored = batch.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber").distinct()
    return batch, load.insert_or_ignore(stored, batch, ["l_orderkey", "l_linenumber"], _LINE.split(", "))


@query("insert_or_ignore", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM q_line_new")
def insert_or_ignore(spark, d):
    return _line_load(spark, d)[1].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


@query("first_in_file_order", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'early' ELSE 'late' END AS file, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def first_in_file_order(spark, d):
    """A small file comes before a large one by name; keys that both hold are taken from the first."""
    orders = derived.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    folder = new_path(spark, "batch")
    for name, part in (("a-early", orders.filter("o_orderkey % 10 = 3")), ("b-late", orders)):
        part.select("o_orderkey", F.lit(name[2:]).alias("file"), "o_totalprice").write.parquet(f"{folder}/{name}")
    batch = spark.read.schema("o_orderkey bigint, file string, o_totalprice double").parquet(f"{folder}/a-early", f"{folder}/b-late")
    return load.insert_or_ignore(orders.filter("o_orderkey % 7 = 0"), batch, ["o_orderkey"])


@query("load_counts", """
SELECT l_linestatus, coalesce(CAST(n AS BIGINT), 0) AS inserted, seen - coalesce(n, 0) AS skipped_duplicates, errors
FROM (SELECT l_linestatus, count(*) AS seen, count(*) FILTER (l_quantity >= 50) AS errors FROM lineitem GROUP BY 1) LEFT JOIN (SELECT l_linestatus, count(*) AS n FROM q_line_new GROUP BY 1) USING (l_linestatus)""")
def load_counts(spark, d):
    batch, fresh = _line_load(spark, d)
    judged = batch.withColumn("reason", F.when(F.col("l_quantity") >= 50, "quantity too large"))
    return load.load_counts(batch, fresh, load.split_rejects(judged)[1], ["l_linestatus"])


@query("accrued_credit", "SELECT 'sc-' || id AS id, household_id, refund_destination AS kind, abs(amount_cents) AS amount_cents, id AS order_item_id FROM v_order_items WHERE is_return AND refund_destination <> 'card' AND shipped >= DATE '1998-01-01'")
def accrued_credit(spark, d):
    items = household(spark, d, "order_items")
    stored = items.filter(F.col("shipped") < F.lit("1998-01-01").cast("date"))
    return load.accrue_credit(load.insert_or_ignore(stored, items, ["order_id", "shipment_id", "item_seq"]))


# ---- match sink
fragment("q_ri_pos", "SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY line_no, id) AS pos FROM v_receipt_items")
fragment("q_oi_pos", "SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY shipment_id, item_seq, id) AS pos FROM v_order_items WHERE NOT is_return")
fragment("q_expanded", """
WITH m AS (SELECT *, CAST(floor(confidence * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS pct FROM e_all_matches WHERE transaction_id IS NOT NULL),
r AS (SELECT m.match_id, ri.id AS ri, ri.pos FROM m JOIN q_ri_pos ri ON m.status = 'auto_linked' AND ri.receipt_id = m.receipt_id),
o AS (SELECT m.match_id, oi.id AS oi, oi.pos FROM m JOIN q_oi_pos oi ON m.status = 'auto_linked' AND oi.order_id = m.order_id),
z AS (SELECT coalesce(r.match_id, o.match_id) AS match_id, ri, oi FROM r FULL JOIN o ON r.match_id = o.match_id AND r.pos = o.pos)
SELECT 'm-' || m.match_id || CASE WHEN z.match_id IS NULL THEN '' WHEN m.match_id IN (SELECT match_id FROM r) AND m.match_id IN (SELECT match_id FROM o) THEN '-' || coalesce(oi, 'x') || '-' || coalesce(ri, 'x')
    WHEN oi IS NOT NULL THEN '-oi-' || oi ELSE '-ri-' || ri END AS id,
  m.household_id, m.transaction_id, oi AS order_item_id, ri AS receipt_item_id, m.receipt_id, m.order_id, CASE WHEN m.status = 'auto_linked' THEN 'matched' ELSE 'pending' END AS status, pct AS confidence, m.type AS method, m.credit_id
FROM m LEFT JOIN z ON z.match_id = m.match_id""")


def _expanded(spark, d):
    i = inputs(spark, d)
    return sink.expand_matches(engine.reconcile(i).matches, i.receipt_items, i.order_items)


@query("expanded_matches", "SELECT * FROM q_expanded")
def expanded_matches(spark, d):
    return _expanded(spark, d).drop("rationale")


fragment("q_desired", """
SELECT id, household_id, transaction_id, order_item_id, receipt_item_id, receipt_id, order_id, CASE WHEN confidence < 20 THEN 'pending' ELSE 'matched' END AS status, confidence // 2 * 2 AS confidence, method
FROM v_matches WHERE status <> 'rejected'""")
fragment("q_human", "SELECT * FROM v_matches WHERE NOT (starts_with(id, 'm-') AND status IN ('matched', 'pending'))")
fragment("q_wanted", "SELECT * FROM q_desired WHERE NOT (status = 'pending' AND transaction_id IN (SELECT transaction_id FROM v_matches WHERE status = 'manual')) AND id NOT IN (SELECT id FROM q_human)")


def _synced(spark, d):
    stored = household(spark, d, "matches").withColumn("rationale", F.lit("")).withColumn("credit_id", F.lit(None).cast("string"))
    fresh = stored.filter(F.col("status") != "rejected").withColumn("status", F.when(F.col("confidence") < 20, "pending").otherwise("matched"))
    fresh = fresh.withColumn("confidence", F.col("confidence") - F.col("confidence") % 2)
    return sink.sync_matches(stored, fresh)


@query("synced_matches", """
SELECT id, household_id, transaction_id, order_item_id, receipt_item_id, receipt_id, order_id, status, confidence, method FROM q_human
UNION ALL SELECT id, household_id, transaction_id, order_item_id, receipt_item_id, receipt_id, order_id, status, confidence, method FROM q_wanted""")
def synced_matches(spark, d):
    return _synced(spark, d)[0].drop("rationale", "credit_id")


@query("synced_changes", """
SELECT coalesce(o.household_id, n.household_id) AS household_id, coalesce(o.id, n.id) AS id,
  CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.status = n.status AND o.confidence = n.confidence THEN 'keep' ELSE 'update' END AS op
FROM (SELECT * FROM v_matches WHERE starts_with(id, 'm-') AND status IN ('matched', 'pending')) o FULL JOIN q_wanted n ON o.id = n.id""")
def synced_changes(spark, d):
    return _synced(spark, d)[1]


_NAMES = " ".join("WHEN '{}' THEN '{}'".format(n, i) for i, n in CATEGORIES.items())


@query("stamped_categories", f"""
SELECT ri.household_id, ri.id, coalesce(ri.category_id, CASE e.category {_NAMES} END) AS category_id
FROM v_receipt_items ri LEFT JOIN (SELECT receipt_item_id, max(category) AS category FROM e_items WHERE receipt_item_id IS NOT NULL GROUP BY 1) e ON e.receipt_item_id = ri.id""")
def stamped_categories(spark, d):
    i = inputs(spark, d)
    return sink.stamp_categories(i.receipt_items, engine.reconcile(i).items).select("household_id", "id", "category_id")


# ---- reads
fragment("q_named_items", "SELECT * FROM v_receipt_items JOIN q_categories USING (category_id)")
fragment("q_counted", "SELECT * FROM q_named_items WHERE id IN (SELECT receipt_item_id FROM v_matches WHERE status IN ('matched', 'manual'))")
fragment("q_live", """
SELECT c.household_id, category, strftime(purchased_at, '%Y-%m') AS month, -CAST(sum(line_price_cents - discount_cents) AS BIGINT) AS net_cents
FROM q_counted c JOIN v_receipts r ON r.id = c.receipt_id WHERE purchased_at IS NOT NULL GROUP BY ALL""")
fragment("q_links", "SELECT m.*, n.category FROM v_matches m JOIN q_named_items n ON n.id = m.receipt_item_id WHERE m.status IN ('matched', 'manual')")
fragment("q_spend_items", """
SELECT c.household_id, 'receipt_item' AS kind, c.id, coalesce(canonical_name, raw_description) AS description, line_price_cents - discount_cents AS amount_cents, category, strftime(purchased_at, '%Y-%m') AS month
FROM q_counted c JOIN v_receipts r ON r.id = c.receipt_id
UNION ALL SELECT oi.household_id, 'order_item', oi.id, description, amount_cents, category, strftime(order_date, '%Y-%m') FROM v_order_items oi JOIN v_orders o ON o.id = oi.order_id JOIN q_links l ON l.order_item_id = oi.id
UNION ALL SELECT DISTINCT t.household_id, 'transaction', t.id, normalized_merchant, amount_cents, category, strftime(posted_date, '%Y-%m') FROM v_tx t JOIN q_links l ON l.transaction_id = t.id""")


def _live(spark, d, month=None):
    return rollup.live_rollup(household(spark, d, "receipt_items"), household(spark, d, "receipts"), household(spark, d, "matches"), categories(spark), month)


def _spend_items(spark, d, month=None):
    names = ["receipt_items", "receipts", "order_items", "orders", "transactions", "matches"]
    return reads.true_spend_items(*[household(spark, d, n) for n in names], categories(spark), month)


@query("live_rollup", "SELECT * FROM q_live")
def live_rollup(spark, d):
    return rollup.by_month_and_category(_live(spark, d))


@query("live_rollup_of_month", "SELECT * FROM q_live WHERE month = '1998-02'")
def live_rollup_of_month(spark, d):
    return _live(spark, d, "1998-02")


@query("true_spend_items", "SELECT household_id, kind, id, description, amount_cents, category FROM q_spend_items")
def true_spend_items(spark, d):
    return _spend_items(spark, d, "February")


@query("true_spend_of_month", "SELECT household_id, kind, id, description, amount_cents, category FROM q_spend_items WHERE month = '1998-02'")
def true_spend_of_month(spark, d):
    return _spend_items(spark, d, "1998-02")


@query("true_spend_breakdown", "SELECT r.household_id, r.category, r.month, net_cents, kind, id, description, amount_cents FROM q_live r LEFT JOIN q_spend_items i ON i.household_id = r.household_id AND i.category = r.category")
def true_spend_breakdown(spark, d):
    return reads.true_spend_breakdown(_live(spark, d), _spend_items(spark, d))


@query("match_listing", """
SELECT m.household_id, m.id, transaction_id, order_item_id, receipt_item_id, receipt_id, order_id, CASE m.status WHEN 'pending' THEN 'ambiguous' ELSE 'confirmed' END AS status, confidence AS confidence_pct, method
FROM v_matches m JOIN v_tx t ON t.id = m.transaction_id WHERE m.status <> 'rejected'""")
def match_listing(spark, d):
    out = reads.list_matches(household(spark, d, "matches"), household(spark, d, "transactions"))
    return out.withColumn("confidence_pct", to_pct(F.col("confidence"))).drop("confidence")


@query("ambiguous_groups", "SELECT m.household_id, transaction_id, count(*) AS candidates FROM v_matches m JOIN v_tx t ON t.id = m.transaction_id WHERE m.status = 'pending' GROUP BY ALL")
def ambiguous_groups(spark, d):
    return reads.ambiguous_groups(household(spark, d, "matches"), household(spark, d, "transactions"))


@query("ambiguous_candidates", """
SELECT m.household_id, m.id, transaction_id, order_item_id, receipt_item_id, receipt_id, order_id, 'ambiguous' AS status, confidence AS confidence_pct, method
FROM v_matches m JOIN v_tx t ON t.id = m.transaction_id WHERE m.status = 'pending'""")
def ambiguous_candidates(spark, d):
    out = reads.ambiguous_candidates(household(spark, d, "matches"), household(spark, d, "transactions"))
    return out.withColumn("confidence_pct", to_pct(F.col("confidence"))).drop("confidence")


fragment("q_unmatched", "SELECT * FROM v_tx WHERE NOT pending AND id NOT IN (SELECT transaction_id FROM v_matches)")


@query("unmatched_transactions", "SELECT id, household_id, account_id, posted_date, amount_cents, direction, normalized_merchant FROM q_unmatched")
def unmatched_transactions(spark, d):
    out = reads.unmatched_transactions(household(spark, d, "transactions"), household(spark, d, "matches"))
    return out.select("id", "household_id", "account_id", "posted_date", "amount_cents", "direction", "normalized_merchant")


@query("account_summary", """
SELECT a.id, a.household_id, a.name, a.type, a.login_id, count(t.id) AS transactions, max(posted_date) AS latest_posted, CASE WHEN a.login_id IS NULL THEN 'other' ELSE 'connected' END AS section
FROM v_accounts a LEFT JOIN v_tx t ON t.account_id = a.id GROUP BY ALL""")
def account_summary(spark, d):
    return reads.account_summary(household(spark, d, "accounts"), household(spark, d, "transactions"))


@query("evidence", """
SELECT i.household_id, i.item_id, CASE WHEN r.id IS NOT NULL THEN 'receipt_region' WHEN o.id IS NOT NULL THEN 'order_row' WHEN t.id IS NOT NULL THEN 'bank_line' ELSE 'not_found' END AS kind, coalesce(r.receipt_id, o.order_id) AS parent_id,
  r.id IS NOT NULL AND r.quantity < 25 AS boxed
FROM (SELECT household_id, receipt_item_id AS item_id FROM v_matches UNION SELECT household_id, order_item_id FROM v_matches WHERE order_item_id IS NOT NULL UNION SELECT household_id, transaction_id FROM v_matches) i
LEFT JOIN v_receipt_items r ON r.id = i.item_id AND r.household_id = i.household_id LEFT JOIN v_order_items o ON o.id = i.item_id LEFT JOIN v_tx t ON t.id = i.item_id""")
def evidence(spark, d):
    m = household(spark, d, "matches")
    ids = (
        m.select("household_id", F.col("receipt_item_id").alias("item_id")).union(m.filter("order_item_id IS NOT NULL").select("household_id", "order_item_id"))
        .union(m.select("household_id", "transaction_id")).distinct()
    )
    box = F.when(F.col("quantity") < 25, '{"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.05}').otherwise("[oops")
    ri = household(spark, d, "receipt_items").withColumn("bbox", box)
    out = reads.resolve_evidence(ids, ri, household(spark, d, "order_items"), household(spark, d, "transactions"))
    return out.withColumn("boxed", F.col("bbox").isNotNull()).drop("bbox")


@query("memberships", """
SELECT c_custkey AS user_id, lower(c_name) AS email, c_name AS display_name, household_id, role FROM customer LEFT JOIN (
  SELECT o_custkey, 'hh-' || l_suppkey AS household_id, o_orderpriority AS role FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, 'hh-' || l_suppkey, o_orderpriority) = 1) ON o_custkey = c_custkey""")
def memberships(spark, d):
    """Customers as users who joined the household of every supplier they ever bought from."""
    users = derived.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("email"), F.col("c_name").alias("display_name"))
    bought = derived.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_shipdate")
    joined = derived.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(bought, "o_orderkey").select(
        F.col("o_custkey").alias("user_id"), F.col("l_shipdate").alias("created_at"), F.concat(F.lit("hh-"), F.col("l_suppkey").cast("string")).alias("household_id"), F.col("o_orderpriority").alias("role")
    )
    return reads.members(users, joined)


@query("refreshed_profiles", "SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN upper(c_name) ELSE c_name END AS email, CASE WHEN c_acctbal > 0 THEN 'seen' ELSE c_name END AS display_name FROM customer")
def refreshed_profiles(spark, d):
    c = derived.table(spark, d, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), F.col("c_name").alias("display_name"))
    signed_in = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 0, F.upper("c_name")).alias("email"), F.lit("seen").alias("display_name"))
    return reads.refresh_profiles(users, signed_in)


# ---- queue
fragment("q_learned", """
SELECT household_id, key, min(store) AS store FROM (SELECT DISTINCT household_id, store, regexp_replace(replace(upper(store), ' WHSE', ''), ' 118$', '') AS key FROM v_receipts WHERE store <> '') GROUP BY ALL""")
fragment("q_shown", """
SELECT DISTINCT household_id, normalized_merchant, CASE normalized_merchant WHEN 'COSTCO WHSE' THEN 'Costco' WHEN 'TRADER JOE S' THEN 'Trader Joe''s' WHEN 'WALMART' THEN 'Walmart' WHEN 'HOME DEPOT' THEN 'Home Depot'
  WHEN 'CVS PHARMACY' THEN 'CVS' WHEN 'TARGET' THEN 'Target' END AS merchant FROM v_tx""")
fragment("q_queue", """
SELECT ri.household_id, 'sku_resolution' AS type, ri.id, 'Low-confidence SKU resolution: "' || raw_description || '"' AS reason, line_price_cents AS amount_cents, receipt_id, store, purchased_at AS happened_on,
  source = 'photo' AS has_image, sku, canonical_name, category_id, CAST(NULL AS BIGINT) AS item_count FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id WHERE ri.needs_review
UNION ALL SELECT m.household_id, 'ambiguous_match', transaction_id, 'Ambiguous match: ' || count(*) || CASE WHEN count(*) = 1 THEN ' candidate' ELSE ' candidates' END || ' for transaction', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM v_matches m JOIN v_tx t ON t.id = m.transaction_id WHERE m.status = 'pending' GROUP BY m.household_id, transaction_id
UNION ALL SELECT u.household_id, 'missing_receipt', id, merchant || ' charge — upload the receipt for an item breakdown', amount_cents, NULL, merchant, posted_date, NULL, NULL, NULL, NULL, NULL
  FROM q_unmatched u JOIN q_shown s USING (household_id, normalized_merchant) WHERE amount_cents < 0 AND merchant IS NOT NULL AND datediff('day', posted_date, DATE '1998-06-01') BETWEEN -1 AND 60
UNION ALL SELECT r.household_id, 'flagged_receipt', r.id, CASE WHEN store = '' AND total_cents = 0 THEN 'Flagged receipt: photo could not be read' ELSE 'Flagged receipt: arithmetic check failed (' || store || ')' END, total_cents, r.id,
  nullif(store, ''), purchased_at, source = 'photo', NULL, NULL, NULL, coalesce(n, 0) FROM v_receipts r LEFT JOIN (SELECT receipt_id, count(*) AS n FROM v_receipt_items GROUP BY 1) ON receipt_id = r.id WHERE needs_review""")


@query("review_queue", "SELECT q.* FROM q_queue q WHERE (household_id, type, id) NOT IN (SELECT (household_id, item_type, item_id) FROM v_decisions)")
def review_queue(spark, d):
    names = ["receipts", "receipt_items", "transactions", "matches", "review_decisions"]
    found = queue.review_queue(*[household(spark, d, n) for n in names], derived.AS_OF)
    return queue.queue_for_display(found).drop("offer")


@query("learned_stores", """SELECT household_id, key, array_to_string(list_transform(string_split(regexp_replace(replace(upper(store), ' WHSE', ''), ' 118$', ''), ' '), lambda t: CASE WHEN length(t) <= 1 THEN t ELSE t[1] || lower(t[2:]) END), ' ') AS display FROM q_learned""")
def learned_stores(spark, d):
    return queue.learned_stores(household(spark, d, "receipts"))


@query("charge_summary", """
SELECT t.household_id, id, normalized_merchant AS merchant, coalesce(s.merchant, normalized_merchant) AS display_merchant, amount_cents, posted_date FROM v_tx t JOIN q_shown s USING (household_id, normalized_merchant)""")
def charge_summary(spark, d):
    return queue.charge_summary(household(spark, d, "transactions"), household(spark, d, "receipts"))


fragment("q_brands", "SELECT DISTINCT p_brand AS household_id, p_name FROM part")


@query("learned_merchants", """
SELECT household_id, p_name AS merchant_line, list_aggregate(list_transform(string_split(upper(k), ' '), lambda t: t[1] || lower(t[2:])), 'string_agg', ' ') AS merchant
FROM (SELECT l.household_id, upper(l.p_name) || ' DIRECT' AS p_name, min(s.p_name) AS k FROM (SELECT DISTINCT household_id, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS p_name FROM q_brands) l
  JOIN q_brands s ON s.household_id = l.household_id AND contains(' ' || l.p_name || ' ', ' ' || s.p_name || ' ') GROUP BY ALL)""")
def learned_merchants(spark, d):
    part = derived.table(spark, d, "part")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    bank = part.select(F.col("p_brand").alias("household_id"), F.concat_ws(" ", F.upper(second), F.upper(first), F.upper(second), F.lit("DIRECT")).alias("normalized_merchant")).distinct()
    taught = part.select(F.col("p_brand").alias("household_id"), F.col("p_name").alias("store")).distinct()
    return queue.receipt_merchants(bank, taught).select("household_id", F.col("normalized_merchant").alias("merchant_line"), "merchant")

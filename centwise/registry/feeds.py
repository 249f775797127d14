"""Bank change feed and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from centwise import derived
from centwise.functions.receipt_lines import account_name, account_type
from centwise.operators import feed
from centwise.plans import reconcile as engine
from centwise.registry.catalog import query
from centwise.registry.fragments import fragment
from centwise.registry.imports import _once
from centwise.registry.stored import household
from centwise.sources.feed import page_changes, read_feed
from centwise.sources.tables import load_inputs
from centwise.storage import new_path
from centwise.streaming import jobs

# events as feed changes: fifty to a page; the payload number names the line
fragment("f_changes", """
SELECT 'L' || (user_id // 25) AS login_id, event_id // 50 AS page_no, CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'removed' ELSE 'added' END AS op, 'u' || user_id AS external_account_id,
  'e' || user_id || '-' || kk AS external_id, CASE WHEN event_type <> 'view' THEN CAST(ts AS DATE) END AS posted_date, CASE WHEN event_type <> 'view' THEN -CAST(floor(value * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS amount_cents,
  CASE WHEN event_type <> 'view' THEN 'SHOP' END AS normalized_merchant, CASE WHEN event_type <> 'view' THEN event_type = 'signup' END AS pending,
  CASE WHEN event_type = 'purchase' THEN 'e' || user_id || '-' || ((kk + 1) % 100) END AS pending_external_id
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS kk FROM events)""")


# changes of the reported accounts in feed order; a change stands at its place among its page's changes of one kind
fragment("f_seq", """
SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY page_no, phase, pos, ext) AS i
FROM (SELECT 'acct-' || user_id AS account_id, event_id // 50 AS page_no, phase, row_number() OVER (PARTITION BY user_id // 25, event_id // 50, phase ORDER BY event_id) - 1 AS pos,
        CASE phase WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END AS op, 'e' || user_id || '-' || kk AS ext, CAST(ts AS DATE) AS posted,
        -CAST(floor(value * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS cents, 'Shop #' || kk AS raw, event_type = 'signup' AS pending,
        CASE WHEN event_type = 'purchase' THEN 'e' || user_id || '-' || ((kk + 1) % 100) END AS pend, user_id
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS kk, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS phase FROM events))
WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) = 'error')""")
# one change of every account at a time, with the account's live lines as a list
fragment("f_walk", """
SELECT DISTINCT account_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id VARCHAR, ext VARCHAR, posted DATE, cents BIGINT, raw VARCHAR, pending BOOLEAN, pend VARCHAR)[]) AS live,
  CAST(-1 AS BIGINT) AS page, CAST([] AS VARCHAR[]) AS replaced, CAST(NULL AS VARCHAR) AS what, CAST(NULL AS VARCHAR) AS reset_id FROM f_seq
UNION ALL
SELECT account_id, i,
  CASE act WHEN 'deleted' THEN list_filter(live, lambda x: x.ext <> ext)
    WHEN 'changed' THEN list_append(list_filter(live, lambda x: x.ext <> ext), {id: held.id, ext: ext, posted: posted, cents: cents, raw: raw, pending: pending, pend: pend})
    WHEN 'resolved' THEN list_append(list_filter(live, lambda x: x.ext <> pend), {id: waiting.id, ext: ext, posted: posted, cents: cents, raw: raw, pending: pending, pend: pend})
    WHEN 'new' THEN list_append(live, {id: 'tx-' || sha256(account_id || '|' || ext || '|' || page_no || '|' || pos), ext: ext, posted: posted, cents: cents, raw: raw, pending: pending, pend: pend})
    ELSE live END,
  page_no, CASE act WHEN 'resolved' THEN list_append(replaced, pend) ELSE replaced END,
  CASE act WHEN 'changed' THEN 'modified' WHEN 'new' THEN op ELSE act END,
  CASE WHEN act = 'changed' AND (held.cents IS DISTINCT FROM cents OR held.posted IS DISTINCT FROM posted) THEN held.id WHEN act = 'resolved' AND waiting.cents IS DISTINCT FROM cents THEN waiting.id END
FROM (SELECT *, CASE WHEN op = 'removed' THEN CASE WHEN held IS NOT NULL AND NOT list_contains(replaced, ext) THEN 'deleted' END
        WHEN held IS NOT NULL THEN CASE WHEN op = 'modified' THEN 'changed' END
        WHEN len(list_filter(live, lambda x: x.pend = ext)) > 0 THEN NULL WHEN waiting IS NOT NULL THEN 'resolved' ELSE 'new' END AS act
  FROM (SELECT c.*, w.live, CASE WHEN w.page = c.page_no THEN w.replaced ELSE [] END AS replaced, list_filter(w.live, lambda x: x.ext = c.ext)[1] AS held, list_filter(w.live, lambda x: x.ext = c.pend)[1] AS waiting
    FROM f_walk w JOIN f_seq c ON c.account_id = w.account_id AND c.i = w.i + 1))""")
fragment("f_lines", """
SELECT r.id, account_id, r.ext AS external_id, r.posted AS posted_date, r.cents AS amount_cents, r.raw AS raw_merchant, 'SHOP' AS normalized_merchant, r.pending, r.pend AS pending_external_id, 'GENERAL' AS category_hint
FROM (SELECT account_id, unnest(arg_max(live, i)) AS r FROM f_walk GROUP BY account_id)""")


def _pages(spark, d):
    e = derived.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    user = F.col("user_id").cast("string")

    def line(k):
        return F.concat(F.lit("e"), user, F.lit("-"), k.cast("string"))

    kind = F.col("event_type")
    txn = F.struct(
        line(F.col("k")).alias("transaction_id"), F.concat(F.lit("u"), user).alias("account_id"), F.col("value").alias("amount"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("Shop #"), F.col("k").cast("string")).alias("name"), F.lit(None).cast("string").alias("merchant_name"), (kind == "signup").alias("pending"),
        F.when(kind == "purchase", line((F.col("k") + 1) % 100)).alias("pending_transaction_id"), F.lit("GENERAL").alias("category_detailed"))
    ref = F.struct(F.col("event_id").alias("at"), txn.alias("t"))
    gone = F.struct(F.col("event_id").alias("at"), F.struct(line(F.col("k")).alias("transaction_id"), F.concat(F.lit("u"), user).alias("account_id")).alias("t"))

    def side(cond, what):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, what))), lambda s: s["t"])

    page = F.floor(F.col("event_id") / 50).alias("page_no")
    # a page holds fifty changes at most
    return e.groupBy(F.concat(F.lit("L"), F.floor(F.col("user_id") / 25).cast("string")).alias("login_id"), page).agg(
        F.min("ts").alias("since"), side(kind.isin("signup", "purchase", "error"), ref).alias("added"), side(kind == "click", ref).alias("modified"), side(kind == "view", gone).alias("removed"),
    ).withColumn("cursor", F.concat(F.lit("c"), F.col("page_no").cast("string"))).withColumn("has_more", F.lit(True)).withColumn("update_status", F.lit("ready"))


def _landed(spark, d):
    return _once(spark, d, "feed-pages", lambda path: _pages(spark, d).drop("since").write.json(path))


def _accounts(spark, d):
    """Accounts the logins reported: those whose first event is no error."""
    first = derived.table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"))
    return first.filter("first <> 'error'").select(
        F.concat(F.lit("L"), F.floor(F.col("user_id") / 25).cast("string")).alias("login_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("external_account_id"),
        F.concat(F.lit("acct-"), F.col("user_id").cast("string")).alias("id"))


@query("feed_changes", "SELECT * FROM f_changes")
def feed_changes(spark, d):
    return page_changes(read_feed(spark, _landed(spark, d))).select(
        "login_id", "page_no", "op", "external_account_id", "external_id", "posted_date", "amount_cents", "normalized_merchant", "pending", "pending_external_id")


@query("feed_unknown_accounts", "SELECT login_id, count(*) AS skipped_unknown_account FROM f_changes WHERE external_account_id IN (SELECT 'u' || user_id FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) = 'error') GROUP BY 1")
def feed_unknown_accounts(spark, d):
    return feed.known_accounts(page_changes(read_feed(spark, _landed(spark, d))), _accounts(spark, d))[1]


def _applied(spark, d):
    changes, _ = feed.known_accounts(page_changes(read_feed(spark, _landed(spark, d))), _accounts(spark, d))
    return feed.apply_feed(spark.createDataFrame([], feed.STATE_SCHEMA), changes)


@query("feed_lines", "SELECT * FROM f_lines")
def feed_lines(spark, d):
    return _applied(spark, d).rows


@query("feed_sync_summary", """
SELECT account_id, coalesce(added, 0) AS added, coalesce(modified, 0) AS modified, coalesce(removed, 0) AS removed, coalesce(pending_resolved, 0) AS pending_resolved, coalesce(matches_reset, 0) AS matches_reset
FROM (SELECT account_id, count(*) FILTER (what = 'added') AS added, count(*) FILTER (what = 'modified') AS modified, count(*) FILTER (what = 'deleted') AS removed, count(*) FILTER (what = 'resolved') AS pending_resolved
      FROM f_walk WHERE what IS NOT NULL GROUP BY 1)
FULL JOIN (SELECT account_id, count(*) AS matches_reset FROM f_lines WHERE NOT pending AND id IN (SELECT reset_id FROM f_walk WHERE reset_id IS NOT NULL) GROUP BY 1) USING (account_id)""")
def feed_sync_summary(spark, d):
    result = _applied(spark, d)
    linked = result.rows.select(F.concat(F.lit("m-"), "id").alias("match_id"), F.col("id").alias("transaction_id"), F.when(F.col("pending"), "pending").otherwise("manual").alias("status"))
    return feed.sync_summary(result, linked)


@query("feed_login_summary", """
WITH u AS (SELECT user_id, 'L' || user_id // 25 AS login_id FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) <> 'error'),
a AS (SELECT login_id, count(*) FILTER (user_id % 2 = 1) AS accounts_created, count(*) FILTER (user_id % 2 = 0) AS accounts_updated FROM u GROUP BY 1),
p AS (SELECT 'L' || user_id // 25 AS login_id, count(DISTINCT event_id // 50) AS pages, 'c' || max(event_id // 50) AS cursor FROM events GROUP BY 1),
k AS (SELECT login_id, count(*) AS n FROM f_changes WHERE external_account_id IN (SELECT 'u' || user_id FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) = 'error') GROUP BY 1)
SELECT login_id, cursor, 'ready' AS update_status, coalesce(accounts_created, 0) AS accounts_created, coalesce(accounts_updated, 0) AS accounts_updated, pages, coalesce(n, 0) AS skipped_unknown_account
FROM p LEFT JOIN a USING (login_id) LEFT JOIN k USING (login_id)""")
def feed_login_summary(spark, d):
    """Accounts of users with even numbers are known already."""
    pages, accounts = read_feed(spark, _landed(spark, d)), _accounts(spark, d)
    known = accounts.filter(F.substring("external_account_id", 2, 20).cast("bigint") % 2 == 0)
    return feed.login_summary(pages, feed.known_accounts(page_changes(pages), accounts)[1], known, accounts)


@query("feed_withdrawn_matches", "SELECT 'm-' || id AS match_id, id AS transaction_id, 'manual' AS status FROM f_lines WHERE id NOT IN (SELECT reset_id FROM f_walk WHERE reset_id IS NOT NULL)")
def feed_withdrawn_matches(spark, d):
    result = _applied(spark, d)
    linked = result.rows.select(F.concat(F.lit("m-"), "id").alias("match_id"), F.col("id").alias("transaction_id"), F.lit("manual").alias("status"))
    return feed.withdraw_matches(linked, result)


@query("feed_page_faults", """
SELECT login_id, count(*) AS pages, 'sync cursor did not advance between pages' AS reason
FROM (SELECT login_id, page_no, page_no % 40 = 1 AND lag(page_no) OVER (PARTITION BY login_id ORDER BY page_no) = page_no - 1 AS stuck FROM (SELECT DISTINCT login_id, page_no FROM f_changes))
GROUP BY 1 HAVING bool_or(stuck)""")
def feed_page_faults(spark, d):
    """One page in forty is reported with the cursor of the page before it."""
    cursor = F.concat(F.lit("c"), (F.col("page_no") - F.when(F.col("page_no") % 40 == 1, 1).otherwise(0)).cast("string"))
    return feed.page_faults(read_feed(spark, _landed(spark, d)).withColumn("cursor", cursor))


@query("feed_accounts", """
SELECT 'login-' || c_nationkey AS login_id, 'x' || c_custkey AS external_account_id, c_acctbal > 0 AS was_known, c_name || ' ····' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'checking' ELSE 'credit' END AS type FROM customer""")
def feed_accounts(spark, d):
    c = derived.table(spark, d, "customer")
    key = [F.concat(F.lit("login-"), F.col("c_nationkey").cast("string")).alias("login_id"), F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("external_account_id")]
    mask = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    known = c.filter("c_acctbal > 0").select(*key, F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("old").alias("name"), F.lit("old").alias("type"), F.lit("0").alias("mask"))
    house = F.col("c_mktsegment") == "HOUSEHOLD"
    reported = c.select(
        *key, F.lit(1).alias("seq"), account_name(F.col("c_name"), F.lit("x"), mask).alias("name"),
        account_type(F.when(house, "depository").otherwise("credit"), F.when(house, "checking")).alias("type"), mask.alias("mask"))
    return feed.upsert_accounts(known, reported).select("login_id", "external_account_id", F.col("id").startswith("old-").alias("was_known"), "name", "type")


@query("feed_stream_lines", "SELECT * FROM f_lines")
def feed_stream_lines(spark, d):
    """The feed landed in three parts, each followed by a streaming run; equals ``feed_lines``."""
    pages, log, checkpoint = new_path(spark, "pages"), new_path(spark, "lines-log"), new_path(spark, "stream")
    accounts = _accounts(spark, d)
    since = F.col("since")
    for start, end in [("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")]:
        part = _pages(spark, d).filter((since >= F.lit(start).cast("timestamp_ntz")) & (since < F.lit(end).cast("timestamp_ntz")))
        part.drop("since").write.mode("append").json(pages)
        jobs.sync_feed(spark, pages, accounts, log, checkpoint).awaitTermination()
    return jobs.feed_state(spark, log)


_DROP = ["id", "household_id", "account_id", "posted_date", "amount_cents", "direction", "normalized_merchant"]


def _drops(spark, d, after=None):
    """Three drops of bank lines, each holding the earlier ones again."""
    folder, table, checkpoint = new_path(spark, "drop"), new_path(spark, "dropped"), new_path(spark, "stream")
    tx = household(spark, d, "transactions").filter("NOT pending").select(*_DROP)
    stream_schema = tx.schema
    for until in ["1998-02-20", "1998-04-20", "1999-01-01"]:
        tx.filter(F.col("posted_date") < F.lit(until).cast("date")).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(stream_schema).parquet(folder)
        jobs.ingest_drops(stream, ["id"], table, checkpoint, after).awaitTermination()
    return table, stream_schema


@query("dropped_lines", "SELECT id, household_id, account_id, posted_date, amount_cents, direction, normalized_merchant FROM v_bank")
def dropped_lines(spark, d):
    table, schema = _drops(spark, d)
    return spark.read.schema(schema).parquet(table).select(*_DROP)


@query("rederived_matches", """
SELECT household_id, match_id, type, status FROM e_all_matches WHERE household_id IN (SELECT household_id FROM v_bank WHERE posted_date >= DATE '1998-05-29')""")
def rederived_matches(spark, d):
    """After the last days' lines were written, only their households are reconciled again, from the folders that hold them."""
    out, folder = new_path(spark, "rederived"), new_path(spark, "by-household")
    names = {"transactions": "transactions", "orders": "orders", "order_items": "order_items", "receipts": "receipts", "receipt_items": "receipt_items", "credit": "store_credit", "confirmed": "confirmed"}
    schemas = jobs.store_tables({k: household(spark, d, v) for k, v in names.items()}, folder)
    changed = household(spark, d, "transactions").filter((F.col("posted_date") >= F.lit("1998-05-29").cast("date")) & ~F.col("pending"))
    jobs.rederive(load_inputs(**jobs.touched_tables(spark, folder, schemas, changed)), changed, engine.reconcile, out, 0)
    return spark.read.parquet(out).select("household_id", "match_id", "type", "status")

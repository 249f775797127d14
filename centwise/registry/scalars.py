"""Column functions over text and numbers spelled out from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from centwise import derived
from centwise.config import ASK_WINDOW_DAYS
from centwise.functions import dates, keys, money, receipt_lines, rules, sensitive, similarity, stores, taxonomy, text
from centwise.registry.catalog import query
from centwise.registry.stored import household


def _by_priority(*values):
    prio = F.col("o_orderpriority")
    out = F.when(prio == "1-URGENT", values[0]).when(prio == "2-HIGH", values[1]).when(prio == "3-MEDIUM", values[2])
    return out.when(prio == "4-NOT SPECIFIED", values[3]).otherwise(values[4])


def _by_status(*values):
    status = F.col("o_orderstatus")
    return F.when(status == "F", values[0]).when(status == "O", values[1]).otherwise(values[2])


@query("amount_to_cents", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN p WHEN '2-HIGH' THEN -p WHEN '3-MEDIUM' THEN -p WHEN '4-NOT SPECIFIED' THEN -(p // 100 * 100)
  ELSE CASE o_orderstatus WHEN 'O' THEN p END END AS cents
FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS p FROM orders)""")
def amount_to_cents(spark, d):
    p = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("bigint")
    whole, part = F.floor(p / 100), F.lpad((p % 100).cast("string"), 2, "0")
    plain = F.concat(whole.cast("string"), F.lit("."), part)
    grouped = F.concat(F.lit("$"), F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit("."), part)
    printed = _by_priority(
        grouped, F.concat(F.lit("("), plain, F.lit(")")), F.concat(plain, F.lit("-")), F.concat(F.lit(" -"), whole.cast("string"), F.lit(".")),
        _by_status(F.concat(F.lit("n/a "), plain), F.concat(F.lit("\t+£ "), plain), F.lit("")),
    )
    return derived.table(spark, d, "orders").select("o_orderkey", money.amount_to_cents(printed).alias("cents"))


@query("to_date_any", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def to_date_any(spark, d):
    day = F.col("o_orderdate").cast("date")
    spelled = _by_priority(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00")), F.date_format(day, "yyyy/M/d"), F.date_format(day, "M/d/yyyy"),
        _by_status(F.date_format(day, "MMM d, yyyy"), F.date_format(day, "d MMMM yyyy"), F.date_format(day, "MM-dd-yyyy")),
        _by_status(F.concat(F.lit(" "), F.date_format(day, "yyyy-M-d"), F.lit(" ")), F.upper(F.date_format(day, "MMM. d yyyy")), F.date_format(day, "'day' d 'of' MMM yyyy")),
    )
    return derived.table(spark, d, "orders").select("o_orderkey", dates.to_date_any(spelled).alias("day"))


@query("excel_serial_to_date", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS decoded FROM orders")
def excel_serial_to_date(spark, d):
    day = F.col("o_orderdate").cast("date")
    serial = F.date_diff(day, F.lit("1899-12-31").cast("date")) + 1 + F.lit(0.25)
    return derived.table(spark, d, "orders").select(day.alias("day"), dates.excel_serial_to_date(serial).alias("decoded")).distinct()


@query("clean_bank_merchant", "SELECT raw_merchant, normalized_merchant AS cleaned, upper(replace(replace(raw_merchant, '*', ' '), ' #', ' ')) AS normal FROM v_tx")
def clean_bank_merchant(spark, d):
    raw = F.col("raw_merchant")
    return derived.transactions(spark, d).select(raw, text.clean_bank_merchant(raw).alias("cleaned"), text.normalize_merchant(raw).alias("normal"))


@query("normalize_store", """
SELECT store, CASE WHEN len(kept) = 0 THEN upper(store) ELSE regexp_replace(array_to_string(kept, ' '), '( [0-9]+)+$', '') END AS normal, count(*) AS receipts
FROM (SELECT store, list_filter(string_split(upper(store), ' '), lambda t: NOT regexp_matches(t, '^#[0-9]+$') AND t NOT IN ('WHSE', 'WHOLESALE', 'INC', 'LLC', 'CORP') AND NOT regexp_matches(t, '^[^A-Z0-9]+$')) AS kept
      FROM (SELECT store || CASE WHEN source = 'photo' THEN ' - #12 LLC' ELSE '' END AS store FROM v_receipts)) GROUP BY ALL""")
def normalize_store(spark, d):
    shown = F.concat("store", F.when(F.col("source") == "photo", " - #12 LLC").otherwise("")).alias("store")
    return household(spark, d, "receipts").select(shown).groupBy("store").agg(F.count("*").alias("receipts")).select(
        "store", text.normalize_store(F.col("store")).alias("normal"), "receipts"
    )


@query("normalize_sku", "SELECT DISTINCT 'ks*' || p_name || '  ' || p_type AS raw, upper('ks ' || p_name || ' ' || p_type) AS key FROM part")
def normalize_sku(spark, d):
    raw = F.concat(F.lit("ks*"), "p_name", F.lit("  "), "p_type")
    return derived.table(spark, d, "part").select(raw.alias("raw"), text.normalize_sku(raw).alias("key")).distinct()


@query("strip_leading_zeros", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS number FROM part")
def strip_leading_zeros(spark, d):
    padded = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return derived.table(spark, d, "part").select("p_partkey", text.strip_leading_zeros(padded).alias("number"))


@query("dice", """
WITH t AS (SELECT DISTINCT p_name AS a, p_name || ' ' || lower(p_type) AS b FROM part),
g AS (SELECT *, list_transform(range(1, length(a)), lambda i: a[i:i+1]) AS ga, list_transform(range(1, length(b)), lambda i: b[i:i+1]) AS gb FROM t)
SELECT a, b, CAST(floor(10000 * CAST(2 AS DOUBLE) * list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda x: x = g)), len(list_filter(gb, lambda y: y = g)))))
  / (length(a) + length(b) - 2) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS score FROM g""")
def dice(spark, d):
    a, b = F.col("p_name"), F.concat("p_name", F.lit(" "), F.lower("p_type"))
    pairs = derived.table(spark, d, "part").select(a.alias("a"), b.alias("b")).distinct()
    score = similarity.dice(F.concat(F.lit(" "), F.upper("a")), F.col("b"))
    return pairs.select("a", "b", money.half_up(F.lit(10000) * score).alias("score"))


@query("transaction_keys", """
SELECT id, sha256(account_id || chr(0) || strftime(posted_date, '%Y-%m-%d') || chr(0) || amount_cents || chr(0) || normalized_merchant || chr(0) || h) AS dedup_key, h AS row_hash
FROM (SELECT *, sha256(id || chr(0) || raw_merchant || chr(0)) AS h FROM v_tx)""")
def transaction_keys(spark, d):
    cells = F.array("id", "raw_merchant", F.lit(None).cast("string"))
    tx = derived.transactions(spark, d).withColumn("h", keys.row_hash(cells))
    key = keys.dedup_key(F.col("account_id"), F.col("posted_date"), F.col("amount_cents"), F.col("normalized_merchant"), F.col("h"))
    return tx.select("id", key.alias("dedup_key"), F.col("h").alias("row_hash"))


@query("category_id_for", """
SELECT o_orderpriority, o_orderstatus, CASE o_orderpriority || o_orderstatus WHEN '1-URGENTF' THEN 'groceries' WHEN '1-URGENTO' THEN 'health-medical' WHEN '1-URGENTP' THEN 'transportation'
  WHEN '2-HIGHF' THEN 'books-media' WHEN '2-HIGHO' THEN 'personal-care' WHEN '2-HIGHP' THEN 'housing' WHEN '3-MEDIUMF' THEN 'pet-care' WHEN '3-MEDIUMO' THEN 'home-improvement'
  WHEN '4-NOT SPECIFIEDF' THEN 'dining' END AS category_id,
  CASE o_orderpriority || o_orderstatus WHEN '1-URGENTF' THEN 'Groceries' WHEN '1-URGENTO' THEN 'Health & Medical' WHEN '1-URGENTP' THEN 'Transportation'
  WHEN '2-HIGHF' THEN 'Books & Media' WHEN '2-HIGHO' THEN 'Personal Care' WHEN '2-HIGHP' THEN 'Housing' WHEN '3-MEDIUMF' THEN 'Pet Care' WHEN '3-MEDIUMO' THEN 'Home Improvement'
  WHEN '4-NOT SPECIFIEDF' THEN 'Dining' ELSE 'Other' END AS name, count(*) AS orders FROM orders GROUP BY ALL""")
def category_id_for(spark, d):
    said = _by_priority(
        _by_status(F.lit("groceries"), F.lit(" HEALTH & medical"), F.lit("Transport")), _by_status(F.lit("Books and Media"), F.lit("personal care"), F.lit("mortgage_rent")),
        _by_status(F.lit("Pet  Care"), F.lit("Home-Improvement"), F.lit("zebra")), _by_status(F.lit("DINING"), F.lit(""), F.lit("foods")), F.lit(None).cast("string"),
    )
    cid = taxonomy.category_id_for(said)
    named = taxonomy.clamp_to_taxonomy(F.coalesce(taxonomy.category_name_for(cid), F.lit("?")))
    return derived.table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders")).select("o_orderpriority", "o_orderstatus", cid.alias("category_id"), named.alias("name"), "orders")


@query("legacy_category_remap", """
SELECT p_type, o, CASE o WHEN 0 THEN 'transportation' WHEN 1 THEN 'housing' WHEN 2 THEN 'books-media' WHEN 3 THEN 'pet-care' ELSE 'other' END AS category_id, count(*) AS parts
FROM (SELECT p_type, CAST(p_size % 5 AS BIGINT) AS o FROM part) GROUP BY ALL""")
def legacy_category_remap(spark, d):
    o = (F.col("p_size") % 5).cast("bigint")
    kinds = derived.table(spark, d, "part").groupBy("p_type", o.alias("o")).agg(F.count("*").alias("parts"))
    o = F.col("o")
    old = F.when(o == 0, "Transport (legacy)").when(o == 1, "mortgage_rent").when(o == 2, "Books & Media").when(o == 3, "pet-care").otherwise("fishing")
    return kinds.select("p_type", "o", taxonomy.legacy_remap(old).alias("category_id"), "parts")


def _rule_sql(subject: str, want: str) -> str:
    plain = [(c, p.replace(r"(?!\s*eats)", "").replace("'", "''")) for c, p in rules.KEYWORD_RULES]
    if want == "category":
        return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '(?i){p}') THEN '{c}'" for c, p in plain) + " END"
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '(?i){p}') THEN regexp_extract({subject}, '(?i){p}', 0)" for _, p in plain) + " END"


@query("document_categories", f"SELECT doc_id, {_rule_sql('text', 'category')} AS category, {_rule_sql('text', 'keyword')} AS keyword FROM documents")
def document_categories(spark, d):
    hit = rules.keyword_category(F.col("text"))
    return _dealt(spark, d, "documents", "doc_id").select("doc_id", hit.alias("hit")).select("doc_id", "hit.category", "hit.keyword")


@query("item_classes", f"""
SELECT description, coalesce({_rule_sql("'Amazon ' || description", 'category')}, 'Other') AS category,
  'merchant: Amazon; keyword match: "' || coalesce({_rule_sql("'Amazon ' || description", 'keyword')}, 'no match') || '" → ' || coalesce({_rule_sql("'Amazon ' || description", 'category')}, 'Other') AS rationale, 'Amazon' AS merchant
FROM (SELECT DISTINCT description FROM v_order_items)""")
def item_classes(spark, d):
    c = rules.classify(F.lit("Amazon"), F.col("description"))
    out = household(spark, d, "order_items").select("description").distinct().withColumn("c", c)
    return out.select("description", "c.category", "c.rationale", rules.merchant_from_rationale(F.col("c.rationale")).alias("merchant"))


@query("merchant_fallback", f"""
SELECT id, coalesce({_rule_sql('normalized_merchant', 'category')}, 'Other') AS category,
  'merchant: ' || normalized_merchant || '; no item data, merchant keyword fallback: "' || coalesce({_rule_sql('normalized_merchant', 'keyword')}, 'no keyword match') || '" → ' || coalesce({_rule_sql('normalized_merchant', 'category')}, 'Other') AS rationale
FROM v_bank""")
def merchant_fallback(spark, d):
    names = household(spark, d, "transactions").filter("NOT pending")
    c = names.select("normalized_merchant").distinct().withColumn("c", rules.merchant_fallback(F.col("normalized_merchant")))
    return names.join(c, "normalized_merchant").select("id", "c.category", "c.rationale")


@query("receipt_capable", """
SELECT id, CASE normalized_merchant WHEN 'COSTCO WHSE' THEN 'Costco' WHEN 'TRADER JOE S' THEN 'Trader Joe''s' WHEN 'WALMART' THEN 'Walmart' WHEN 'HOME DEPOT' THEN 'Home Depot'
  WHEN 'CVS PHARMACY' THEN 'CVS' WHEN 'TARGET' THEN 'Target' END AS chain, datediff('day', posted_date, DATE '1998-06-01') BETWEEN -1 AND 60 AS ask FROM v_tx""")
def receipt_capable(spark, d):
    ask = dates.within_ask_window(F.col("posted_date"), F.lit(derived.AS_OF).cast("date"), ASK_WINDOW_DAYS)
    return derived.transactions(spark, d).select("id", stores.builtin_chain(F.col("raw_merchant")).alias("chain"), ask.alias("ask"))


@query("store_keys", """
SELECT store, normal, learnable, array_to_string(list_transform(string_split(normal, ' '), lambda t: CASE WHEN length(t) <= 1 OR regexp_matches(t, '[0-9]') THEN t ELSE t[1] || lower(t[2:]) END), ' ') AS title
FROM (SELECT store, normal, normal NOT IN ('', 'TARGET') AS learnable FROM (SELECT DISTINCT store, CASE WHEN store = '' THEN '' ELSE regexp_replace(replace(upper(store), ' WHSE', ''), ' 118$', '') END AS normal FROM v_receipts))""")
def store_keys(spark, d):
    key = stores.learned_key(F.col("store"))
    return household(spark, d, "receipts").select("store").distinct().select("store", key.alias("normal"), stores.learnable(key).alias("learnable"), text.title_case(key).alias("title"))


@query("refund_destinations", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'gift_card' WHEN '2-HIGH' THEN 'store_credit' WHEN '3-MEDIUM' THEN 'account_balance' WHEN '4-NOT SPECIFIED' THEN 'card' END AS method,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'gift_card' WHEN '2-HIGH' THEN 'card' WHEN '4-NOT SPECIFIED' THEN 'card' END AS tender,
  o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') AS card, CASE WHEN o_orderpriority <> '5-LOW' THEN lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS last4 FROM orders""")
def refund_destinations(spark, d):
    method = _by_priority(F.lit("Visa and Gift Card"), F.lit("Store Credit"), F.lit("Amazon balance"), F.lit("MasterCard - 1"), F.lit("cheque"))
    number = F.concat(F.lit("**** "), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), _by_priority(F.lit(" "), F.lit(""), F.lit("\t"), F.lit(""), F.lit("x")))
    return derived.table(spark, d, "orders").select(
        "o_orderkey", receipt_lines.payment_to_refund_destination(method).alias("method"), receipt_lines.tender_refund_destination(method).alias("tender"),
        receipt_lines.is_card_tender(method).alias("card"), receipt_lines.last4(number).alias("last4"),
    )


@query("receipt_line_names", """
SELECT DISTINCT p_name, p_type, CASE p_type WHEN 'ECONOMY' THEN 'Bag fee' WHEN 'SMALL' THEN upper(p_name[1]) || p_name[2:] WHEN 'PROMO' THEN 'Premium Gasoline' WHEN 'LARGE' THEN 'Bottle deposit' END AS name FROM part""")
def receipt_line_names(spark, d):
    kind = F.col("p_type")
    printed = F.when(kind == "ECONOMY", "BAG  FEE").when(kind == "LARGE", "bottle deposit").otherwise(F.upper("p_name"))
    actual = F.when(kind == "SMALL", F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))).when(kind == "STANDARD", F.upper("p_name"))
    named = receipt_lines.line_name(F.when(kind == "ECONOMY", 0).otherwise(F.lit(None)), printed, actual, kind == "PROMO", F.when(kind == "PROMO", "PREMIUM"))
    return derived.table(spark, d, "part").select("p_name", "p_type", named.alias("name")).distinct()


@query("identity_names", "SELECT DISTINCT p_name, p_type, upper(p_name[1]) || p_name[2:] AS name FROM part")
def identity_names(spark, d):
    nice = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    size = F.col("p_size").cast("string")
    dressed = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(nice, F.lit(", "), size, F.lit(" fl oz"))).when(F.col("p_type") == "SMALL", F.concat(nice, F.lit(" ("), size, F.lit(" ct)")))
        .when(F.col("p_type") == "PROMO", F.concat(nice, F.lit(" "), size, F.lit(" rolls"))).when(F.col("p_type") == "LARGE", F.concat(nice, F.lit(" per lb"))).otherwise(nice)
    )
    return derived.table(spark, d, "part").select("p_name", "p_type", receipt_lines.identity_name(dressed).alias("name")).distinct()


@query("money_scalars", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS cents, CAST(floor(l_discount * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS pct,
  -CAST(floor(l_quantity) AS BIGINT) AS spend, CASE WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN 'auto_linked' ELSE 'review' END AS routed,
  CASE WHEN q = 25 THEN 0 ELSE CAST(floor((q - 25) / CAST(25 AS DOUBLE) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS change, strftime(l_shipdate, '%Y-%m') AS month,
  CASE l_returnflag WHEN 'A' THEN 'ambiguous' WHEN 'N' THEN 'confirmed' END AS shown
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def money_scalars(spark, d):
    q = F.col("l_quantity").cast("bigint")
    stored = F.when(F.col("l_returnflag") == "A", "pending").when(F.col("l_returnflag") == "N", "manual").otherwise("rejected")
    return derived.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", money.dollars_to_cents(F.col("l_extendedprice")).alias("cents"), money.to_pct(F.col("l_discount")).alias("pct"),
        money.bank_to_spend(q).alias("spend"), money.route(F.col("l_discount"), 0.05).alias("routed"), money.delta_pct(q, F.lit(25).cast("bigint")).alias("change"),
        dates.month_of(F.col("l_shipdate").cast("date")).alias("month"), money.read_status(stored).alias("shown"),
    )


@query("bounding_boxes", """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(floor(value * 100) AS BIGINT) END AS x100, event_type NOT IN ('error', 'view') AS whole
FROM events""")
def bounding_boxes(spark, d):
    good = F.concat(F.lit('{"x": '), F.col("value").cast("string"), F.lit(', "y": 0.5, "width": 0.1, "height": 0.2}'))
    raw = F.when(F.col("event_type") == "error", F.lit("{not json")).when(F.col("event_type") == "view", F.col("props")).otherwise(good)
    box = receipt_lines.parse_bbox(raw)
    return derived.table(spark, d, "events").select("event_id", F.floor(box["x"] * 100).cast("bigint").alias("x100"), box.isNotNull().alias("whole"))


@query("account_names", """
SELECT c_custkey, c_name || ' ····' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'depository' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'checking' ELSE 'credit' END AS type FROM customer""")
def account_names(spark, d):
    seg = F.col("c_mktsegment")
    kind = F.when(seg.isin("BUILDING", "HOUSEHOLD"), "depository").otherwise("credit")
    mask = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    return derived.table(spark, d, "customer").select(
        "c_custkey", receipt_lines.account_name(F.lit(None).cast("string"), F.concat("c_name", F.lit(" ")), mask).alias("name"),
        receipt_lines.account_type(kind, F.when(seg == "HOUSEHOLD", "checking")).alias("type"),
    )


def _dealt(spark, d, table, ident):
    """A table's texts over as many tasks as a shuffle has: a file of one row group is one task else, and patterns cost more than the shuffle."""
    return derived.table(spark, d, table).select(ident, "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), ident)


def _hits(df, ident):
    return df.select(ident, F.explode(sensitive.sensitive_hits(F.col("text"))).alias("h")).groupBy(ident, "h.kind", "h.match").agg(F.count("*").alias("hits"))


_SQL_PATTERNS = {
    "pan": "[0-9]{13,19}", "pan_grouped": r"\b(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\b", "masked_last4": r"[*xX#•●]{2,}[ -]?[0-9]{4}\b",
    "ending_in": r"(?i)ending(?:\s+in)?\s*[:#-]?\s*[0-9]{4}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "api_key": r"\bsk-[A-Za-z0-9_-]{20,}|\bAKIA[A-Z0-9]{16}\b",
}


def _hits_sql(table: str, ident: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {ident}, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 0)) AS match FROM {table}" for k, p in _SQL_PATTERNS.items())
    return f"SELECT {ident}, kind, match, count(*) AS hits FROM ({parts}) GROUP BY ALL"


@query("sensitive_documents", _hits_sql("documents", "doc_id"))
def sensitive_documents(spark, d):
    return _hits(_dealt(spark, d, "documents", "doc_id"), "doc_id")


@query("sensitive_conversations", _hits_sql("conversations", "conv_id"))
def sensitive_conversations(spark, d):
    return _hits(derived.table(spark, d, "conversations").select("conv_id", "text"), "conv_id")



_LAST4 = "lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0')"


@query("sensitive_messages", f"""
SELECT conv_id, kind, match, count(*) AS hits FROM (
  SELECT conv_id, CASE (conv_id + turn) % 5 WHEN 0 THEN 'pan_grouped' WHEN 1 THEN 'ending_in' WHEN 2 THEN 'ssn' WHEN 3 THEN 'api_key' ELSE 'masked_last4' END AS kind,
    CASE (conv_id + turn) % 5 WHEN 0 THEN '4111 2222 3333 ' || {_LAST4} WHEN 1 THEN 'Ending in ' || {_LAST4} WHEN 2 THEN '123-45-' || {_LAST4}
      WHEN 3 THEN 'sk-' || translate(md5(CAST(conv_id AS VARCHAR)), '0123456789', 'ghijklmnop') ELSE '****' || {_LAST4} END AS match
  FROM conversations) GROUP BY ALL""")
def sensitive_messages(spark, d):
    """Every message with a card, a number or a key written into it; the check names what was written, it doesn't search."""
    last4 = F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0")
    key = F.translate(F.md5(F.col("conv_id").cast("string")), "0123456789", "ghijklmnop")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    written = (
        F.when(kind == 0, F.concat(F.lit("card 4111 2222 3333 "), last4, F.lit(" thanks"))).when(kind == 1, F.concat(F.lit("Ending in "), last4, F.lit("."))).when(kind == 2, F.concat(F.lit("(123-45-"), last4, F.lit(")")))
        .when(kind == 3, F.concat(F.lit("key=sk-"), key, F.lit("!"))).otherwise(F.concat(F.lit("xx ****"), last4, F.lit(" on file")))
    )
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", ""), F.lit(" "), written)
    return _hits(derived.table(spark, d, "conversations").select("conv_id", text.alias("text")), "conv_id")

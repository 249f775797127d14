"""Sources by round trip: household tables are written as export files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from centwise.operators import dictionary, receipts
from centwise.registry.catalog import query
from centwise.registry.fragments import fragment
from centwise.registry.stored import household
from centwise.sources.bank_csv import read_bank_csv
from centwise.sources.digital_receipts import read_digital_receipts
from centwise.sources.extractions import read_extractions
from centwise.sources.order_csv import read_order_history
from centwise.sources.registry import ImportContext, import_source
from centwise.storage import new_path

_paths: dict[tuple, str] = {}


def _once(spark, d, name, write):
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _paths:
        path = new_path(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


def _dollars(cents):
    a = F.abs(cents)
    return F.concat(F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


# ---- bank statements, one file per hundred households
def _bank_files(spark, d):
    def write(path):
        t = household(spark, d, "transactions").withColumn("grp", F.substring("household_id", 1, 10))
        money = _dollars(F.col("amount_cents"))
        shown = (
            F.when(F.col("pending"), "n/a").when(F.col("direction") == "credit", F.concat(F.lit("$"), money))
            .when(F.col("amount_cents") % 2 == 0, F.concat(F.lit("("), money, F.lit(")"))).otherwise(F.concat(F.lit("-"), money))
        )
        line = F.concat(
            F.date_format("posted_date", "M/d/yyyy"), F.lit(","), "id", F.lit(',"'), "raw_merchant", F.lit('","12 ""Main"" St, Town","'), shown, F.lit('"'))
        body = t.select("grp", F.concat(F.lit("9"), "id").alias("ord"), line.alias("value"))
        top = ["Statement of account", "Prepared for,A. Customer", "Period,1998", "", "Balances in USD,,", "Posted Date,Reference Number,Payee,Address,Amount"]
        heads = t.select("grp").distinct().select("grp", F.posexplode(F.array(*[F.lit(x) for x in top])).alias("i", "value"))
        rows = body.unionByName(heads.select("grp", F.concat(F.lit("1"), F.col("i").cast("string")).alias("ord"), "value"))
        rows.repartition("grp").sortWithinPartitions("grp", "ord").select("grp", "value").write.partitionBy("grp").option("compression", "gzip").text(path)

    return _once(spark, d, "bank-csv", write)


@query("bank_csv_rows", "SELECT posted_date, amount_cents, direction, raw_merchant, normalized_merchant, count(*) AS n FROM v_tx WHERE NOT pending GROUP BY ALL")
def bank_csv_rows(spark, d):
    rows, _ = read_bank_csv(spark, _bank_files(spark, d))
    return rows.groupBy("posted_date", "amount_cents", "direction", "raw_merchant", "normalized_merchant").agg(F.count("*").alias("n"))


@query("bank_csv_rejects", "SELECT 'bank' AS source, 'unparseable amount: n/a' AS reason, count(*) AS n FROM v_tx WHERE pending GROUP BY ALL")
def bank_csv_rejects(spark, d):
    _, bad = read_bank_csv(spark, _bank_files(spark, d))
    return bad.groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("imported_bank_keys", "SELECT count(*) AS lines, count(DISTINCT id) AS keys FROM v_tx WHERE NOT pending")
def imported_bank_keys(spark, d):
    got = import_source(spark, "bank", _bank_files(spark, d), ImportContext("hh-import", "acct-import"))
    return got.tables["transactions"].agg(F.count("*").alias("lines"), F.countDistinct("dedup_key").alias("keys"))


# ---- order history
def _order_files(spark, d):
    def write(path):
        o = household(spark, d, "orders").select(F.col("id").alias("order_id"), "external_order_id", "order_date")
        i = household(spark, d, "order_items").join(o, "order_id")
        dest = F.col("refund_destination")
        method = F.when(dest == "gift_card", "Gift Card").when(dest == "store_credit", "Store Credit").otherwise("Visa - 1234")
        amount = F.when(F.col("quantity") == 50, "free").otherwise(F.concat(F.when(F.col("amount_cents") < 0, "-").otherwise(""), F.lit("$"), _dollars(F.col("amount_cents"))))
        out = i.select(
            F.lit("A1").alias("ASIN"), F.lit("USD").alias("Currency"), F.concat("shipment_id", F.lit("T01:02:03Z")).alias("Ship Date"), F.date_format("order_date", "MM/dd/yyyy").alias("Order Date"),
            F.col("external_order_id").alias("Order ID"), F.lit("Closed").alias("Order Status"), F.col("quantity").cast("int").alias("Original Quantity"), method.alias("Payment Method Type"),
            F.concat("description", F.lit(', "boxed"\nset')).alias("Product Name"), F.when(F.col("quantity") < 10, "").otherwise(amount).alias("Total Amount"), amount.alias("Shipment Item Subtotal"),
            F.lit("Shipped").alias("Shipment Status"), F.lit("$1.00").alias("Unit Price"), F.lit("Jane Roe, 1 Street").alias("Shipping Address"), F.substring_index("id", "-", -1).cast("int").alias("ln"),
        )
        out.repartition("Order ID").sortWithinPartitions("Order ID", "ln").drop("ln").write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)

    return _once(spark, d, "order-csv", write)


fragment("m_items", """
SELECT external_order_id, shipment_id, row_number() OVER (PARTITION BY order_id, shipment_id ORDER BY CAST(split_part(oi.id, '-', 3) AS INTEGER)) AS item_seq, description || ', "boxed"' || chr(10) || 'set' AS description,
  CAST(quantity AS BIGINT) AS quantity, amount_cents, is_return, refund_destination, order_date FROM v_order_items oi JOIN v_orders o ON o.id = oi.order_id WHERE quantity <> 50""")


@query("order_history_items", "SELECT * EXCLUDE (order_date) FROM m_items")
def order_history_items(spark, d):
    _, items, _ = read_order_history(spark, _order_files(spark, d))
    return items.select("external_order_id", "shipment_id", "item_seq", "description", F.col("quantity").cast("bigint").alias("quantity"), "amount_cents", "is_return", "refund_destination")


@query("order_history_orders", "SELECT external_order_id, order_date, 'USD' AS currency, CAST(sum(amount_cents) AS BIGINT) AS order_total_cents, count(*) AS items FROM m_items GROUP BY ALL")
def order_history_orders(spark, d):
    orders, _, _ = read_order_history(spark, _order_files(spark, d))
    return orders.drop("file", "source")


@query("order_history_rejects", "SELECT 'unparseable amount: free' AS reason, count(*) AS n FROM v_order_items WHERE quantity = 50 GROUP BY 1")
def order_history_rejects(spark, d):
    return read_order_history(spark, _order_files(spark, d))[2].groupBy("reason").agg(F.count("*").alias("n"))


# ---- digital receipts
def _digital_files(spark, d):
    def write(path):
        # heads and lines are dealt by household once; a receipt and then a document come together where they lie
        r, i = household(spark, d, "receipts"), household(spark, d, "receipt_items")
        head = F.struct("store", "purchased_at", "tax_cents", "total_cents").alias("head")
        line = F.struct("line_no", "sku", "raw_description", "canonical_name", "quantity", "line_price_cents", "discount_cents").alias("line")
        rows = r.select("household_id", F.col("id").alias("receipt_id"), head).unionByName(i.select("household_id", "receipt_id", line), allowMissingColumns=True).repartition("household_id")
        slips = rows.groupBy("household_id", "receipt_id").agg(F.first("head", True).alias("head"), F.array_sort(F.collect_list("line")).alias("lines")).filter("head IS NOT NULL")
        sign = F.when(F.col("head.total_cents") < 0, -1).otherwise(1)
        none = F.lit(None)

        def item(x):
            return F.struct(
                ((x["line_price_cents"] * sign) / F.lit(100.0)).alias("amount"), x["sku"].alias("itemNumber"), x["raw_description"].alias("itemDescription01"),
                x["canonical_name"].alias("itemActualName"), x["quantity"].alias("unit"))

        def saving(x):
            return F.struct(
                (-x["discount_cents"] / F.lit(100.0)).alias("amount"), x["sku"].alias("itemNumber"), F.concat(F.lit("/"), x["sku"]).alias("itemDescription01"), none.cast("string").alias("itemActualName"), none.cast("double").alias("unit"))

        printed = F.flatten(F.transform("lines", lambda x: F.when(x["discount_cents"] > 0, F.array(item(x), saving(x))).otherwise(F.array(item(x)))))
        rec = F.struct(
            F.lit("WarehouseReceiptDetail").alias("documentType"), F.col("receipt_id").alias("transactionBarcode"), F.date_format("head.purchased_at", "yyyy-MM-dd").alias("transactionDate"),
            F.when(F.col("head.total_cents") < 0, "Refund").otherwise("Sales").alias("transactionType"), F.when(F.col("head.store").startswith("HOME DEPOT"), "Gas Station").otherwise("In-Warehouse").alias("receiptType"),
            (F.col("head.tax_cents") / F.lit(100.0)).alias("taxes"), (F.col("head.total_cents") / F.lit(100.0)).cast("string").alias("total"), F.col("receipt_id").alias("invoiceNumber"),
            F.array(F.struct(F.lit("**** 4321").alias("displayAccountNumber"), F.lit("VISA").alias("tenderDescription"))).alias("tenderArray"), F.lit("member 1").alias("membershipNumber"),
            F.when(F.size("lines") > 0, printed).alias("itemArray"),
        )
        # one export document per household, one per line
        doc = slips.select("household_id", rec.alias("rec")).groupBy("household_id").agg(F.to_json(F.struct(F.collect_list("rec").alias("receipts"))).alias("value"))
        doc.select("value").write.option("compression", "gzip").text(path)

    return _once(spark, d, "digital-json", write)


def _read_digital(spark, d):
    return read_digital_receipts(spark, _digital_files(spark, d), per_line=True)


fragment("m_digital", """
SELECT r.id AS barcode, CASE WHEN store LIKE 'HOME DEPOT%' THEN 'COSTCO GAS' ELSE 'COSTCO WHSE' END AS store, purchased_at, tax_cents, total_cents, '4321' AS payment_last4,
  subtotal_cents IS NULL OR abs(coalesce(subtotal_cents, 0) * CASE WHEN total_cents < 0 THEN -1 ELSE 1 END + coalesce(tax_cents, 0) - total_cents) > 2 AS needs_review
FROM v_receipts r WHERE purchased_at IS NOT NULL""")


@query("digital_receipts", "SELECT * FROM m_digital")
def digital_receipts(spark, d):
    return _read_digital(spark, d)[0].select("barcode", "store", "purchased_at", "tax_cents", "total_cents", "payment_last4", "needs_review")


@query("digital_receipt_items", """
SELECT receipt_id AS barcode, line_no, sku, raw_description, canonical_name, CASE WHEN total_cents < 0 THEN -line_price_cents + discount_cents ELSE line_price_cents END AS line_price_cents,
  CASE WHEN total_cents < 0 THEN 0 ELSE discount_cents END AS discount_cents, canonical_name IS NULL AS needs_review FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id""")
def digital_receipt_items(spark, d):
    heads, items, _ = _read_digital(spark, d)
    return items.join(heads.select("entry", "barcode"), "entry").select("barcode", "line_no", "sku", "raw_description", "canonical_name", "line_price_cents", "discount_cents", "needs_review")


@query("digital_receipt_rejects", "SELECT 'missing or invalid transactionDate' AS reason, id AS row_ref FROM v_receipts WHERE purchased_at IS NULL")
def digital_receipt_rejects(spark, d):
    return _read_digital(spark, d)[2].select("reason", "row_ref")


@query("all_rejects", """
SELECT source, reason, n FROM (SELECT 'bank' AS source, 'unparseable amount: n/a' AS reason, count(*) AS n FROM v_tx WHERE pending
UNION ALL SELECT 'orders', 'unparseable amount: free', count(*) FROM v_order_items WHERE quantity = 50 UNION ALL SELECT 'receipts', 'missing or invalid transactionDate', count(*) FROM v_receipts WHERE purchased_at IS NULL) WHERE n > 0""")
def all_rejects(spark, d):
    from centwise.operators.load import union_rejects

    bad = union_rejects(read_bank_csv(spark, _bank_files(spark, d))[1], read_order_history(spark, _order_files(spark, d))[2], _read_digital(spark, d)[2])
    return bad.groupBy("source", "reason").agg(F.count("*").alias("n"))


# every other slip of the till was photographed under its barcode, gas slips under their invoice number
@query("eval_set", """
SELECT file, outcome, expected_items FROM (SELECT r.id || '.png' AS file, CASE WHEN purchased_at IS NULL OR (store NOT LIKE 'HOME DEPOT%' AND source <> 'photo') THEN 'unpaired' WHEN coalesce(n, 0) = 0 THEN 'skipped_empty' ELSE 'written' END AS outcome,
  CASE WHEN purchased_at IS NULL OR (store NOT LIKE 'HOME DEPOT%' AND source <> 'photo') THEN 0 ELSE coalesce(n, 0) END AS expected_items
FROM v_receipts r LEFT JOIN (SELECT receipt_id, count(*) AS n FROM v_receipt_items WHERE canonical_name IS NOT NULL GROUP BY 1) ON receipt_id = r.id)""")
def eval_set(spark, d):
    heads, items, _ = _read_digital(spark, d)
    photo = F.col("source") == "photo"
    manifest = household(spark, d, "receipts").select(
        F.concat("id", F.lit(".png")).alias("file"), F.when(photo, F.col("id")).alias("barcode"), F.when(~photo, F.col("id")).alias("invoice"))
    return receipts.build_eval_set(manifest, heads, items)[1].select("file", "outcome", "expected_items")


# ---- model readings
def _reading_files(spark, d):
    def write(path):
        r = household(spark, d, "receipts").withColumnRenamed("id", "receipt_id")
        broken = F.col("total_cents") < 0
        i = household(spark, d, "receipt_items").drop("household_id", "needs_review").join(r.select("receipt_id", broken.alias("broken")), "receipt_id")
        line = F.struct(
            "line_no", F.struct(F.col("sku"), F.col("raw_description").alias("rawDescription"), "quantity", F.lit(None).cast("bigint").alias("unitPrice"), F.col("line_price_cents").alias("linePrice"),
                                F.when(F.col("broken"), -1).otherwise(F.col("discount_cents")).cast("bigint").alias("discount")).alias("x"))
        lists = i.groupBy("receipt_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["x"]).alias("lineItems"))
        r.join(lists, "receipt_id", "left").select(
            "household_id", "image_hash", (F.col("store") != "").alias("readable"), "store", F.date_format("purchased_at", "yyyy-MM-dd").alias("purchasedAt"), F.col("total_cents").alias("total"),
            F.when(F.col("source") == "photo", F.col("tax_cents") - 5).otherwise(F.col("tax_cents")).alias("tax"),
            F.when(F.col("source") == "photo", F.array(F.struct(F.lit("bag").alias("kind"), F.lit("BAG").alias("label"), F.lit(5).alias("amount")))).alias("fees"),
            F.struct(F.lit("card").alias("method"), F.lit("9876").alias("last4")).alias("paymentHint"), "lineItems",
        ).write.option("compression", "gzip").json(path)

    return _once(spark, d, "readings", write)


fragment("m_built_items", """
SELECT r.image_hash, line_no, ri.sku, k.canonical_name, k.category AS category_id, k.source IS NULL AS needs_review
FROM v_receipt_items ri JOIN v_receipts r ON r.id = ri.receipt_id LEFT JOIN l_resolved x ON x.id = ri.id
LEFT JOIN l_rekeyed k ON k.household_id = x.household_id AND k.store = x.skey AND k.sku_or_abbrev = x.sku2 WHERE total_cents >= 0 AND r.store <> ''""")
fragment("m_built", """
SELECT r.image_hash, CASE WHEN bad THEN '' ELSE store END AS store, CASE WHEN bad THEN 0 ELSE total_cents END AS total_cents, CASE WHEN NOT bad THEN coalesce(subtotal_cents, 0) END AS subtotal_cents,
  CASE WHEN NOT bad THEN '9876' END AS payment_last4, NOT bad AS readable, bad OR coalesce(flagged, false) OR abs(coalesce(subtotal_cents, 0) + coalesce(tax_cents, 0) - total_cents) > 2 AS needs_review
FROM (SELECT *, store = '' OR (total_cents < 0 AND subtotal_cents IS NOT NULL) AS bad FROM v_receipts) r LEFT JOIN (SELECT image_hash, bool_or(needs_review) AS flagged FROM m_built_items GROUP BY 1) USING (image_hash)""")


def _built(spark, d):
    found = read_extractions(spark, _reading_files(spark, d))
    return receipts.build_receipts(found, dictionary.rekey(household(spark, d, "sku_dictionary")))


@query("extraction_rows", "SELECT image_hash, NOT (store = '' OR (total_cents < 0 AND subtotal_cents IS NOT NULL)) AS readable, CASE WHEN NOT (store = '' OR (total_cents < 0 AND subtotal_cents IS NOT NULL)) THEN coalesce(n, 0) ELSE 0 END AS lines FROM v_receipts r LEFT JOIN (SELECT receipt_id, count(*) AS n FROM v_receipt_items GROUP BY 1) ON receipt_id = r.id")
def extraction_rows(spark, d):
    return read_extractions(spark, _reading_files(spark, d)).select("image_hash", "readable", F.size("lines").cast("bigint").alias("lines"))


@query("built_receipts", "SELECT * FROM m_built")
def built_receipts(spark, d):
    return _built(spark, d)[0].select("image_hash", "store", "total_cents", "subtotal_cents", "payment_last4", "readable", "needs_review")


@query("built_receipt_items", "SELECT * FROM m_built_items")
def built_receipt_items(spark, d):
    heads, items = _built(spark, d)
    return items.join(heads.select(F.col("id").alias("receipt_id"), "image_hash"), "receipt_id").select("image_hash", "line_no", "sku", "canonical_name", "category_id", "needs_review")


@query("reread_outcomes", """
SELECT r.image_hash, CASE WHEN has THEN 'has_items' WHEN NOT m.readable THEN 'still_unreadable' ELSE 'replaced' END AS outcome
FROM v_receipts r JOIN m_built m USING (image_hash) JOIN (SELECT r.id, count(ri.id) > 0 AS has FROM v_receipts r LEFT JOIN (SELECT * FROM v_receipt_items WHERE quantity < 10) ri ON ri.receipt_id = r.id GROUP BY 1) h ON h.id = r.id""")
def reread_outcomes(spark, d):
    heads, items = _built(spark, d)
    stored = household(spark, d, "receipts").withColumn("purchased_raw", F.date_format("purchased_at", "yyyy-MM-dd")).withColumn("payment_last4", F.lit(None).cast("string"))
    kept = household(spark, d, "receipt_items").filter(F.col("quantity") < 10)
    return receipts.reread(stored, kept, heads, items)[2].select("image_hash", "outcome")

"""Digital warehouse receipts: JSON, bare array or wrapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from centwise.config import DIGITAL_SOURCE, RECEIPT
from centwise.functions.keys import NUL, hash_of
from centwise.functions.money import dollars_to_cents
from centwise.functions.receipt_lines import (
    SUPPORTED_DOCUMENTS, is_card_tender, last4, line_name, raw_description, tender_refund_destination,
)
from centwise.functions.text import trim
from centwise.storage import cut

# Only commerce fields are declared, so nothing else in the export is ever read.
_TENDER = "struct<displayAccountNumber: string, tenderDescription: string>"
_ITEM = (
    "struct<amount: string, itemNumber: string, itemDescription01: string, itemDescription02: string, itemActualName: string, itemDepartmentNumber: string, "
    "itemUnitPriceAmount: string, unit: string, fuelUnitQuantity: string, fuelUomCode: string, fuelGradeCode: string, fuelGradeDescription: string>"
)
_RECORD_FIELDS = [
    ("documentType", "string"), ("transactionBarcode", "string"), ("transactionDate", "string"), ("transactionDateTime", "string"), ("transactionDateISO", "string"),
    ("transactionType", "string"), ("receiptType", "string"), ("subTotal", "string"), ("taxes", "string"), ("total", "string"), ("invoiceNumber", "string"),
    ("tenderArray", f"array<{_TENDER}>"), ("itemArray", f"array<{_ITEM}>"),
]
_RECORD = "struct<" + ", ".join(f"{n}: {t}" for n, t in _RECORD_FIELDS) + ">"
_SCHEMA = ", ".join(f"{n} {t}" for n, t in _RECORD_FIELDS) + f", receipts array<{_RECORD}>, data struct<receiptsWithCounts: struct<receipts: array<{_RECORD}>>>, _corrupt string"


def _number(c: Column) -> Column:
    return F.when(trim(c) != "", trim(c).try_cast("double"))


def _cents(c: Column) -> Column:
    return dollars_to_cents(_number(c))


def _iso(c: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")


def read_records(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """One row per receipt record: file, doc, seq, rec, or a corrupt text.

    A file is one export document, or with ``per_line`` one document per line,
    which lets large files be read by many tasks.
    """
    rows = spark.read.schema(_SCHEMA).option("multiLine", not per_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    own = F.struct(*[F.col(n) for n, _ in _RECORD_FIELDS])
    listed = F.coalesce("receipts", "data.receiptsWithCounts.receipts", F.array(own))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("doc"), "_corrupt", F.posexplode(listed).alias("seq", "rec"))


def fold_savings(lines: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fold savings lines into the item they follow: (items, orphans).

    ``lines`` has ``pos``, ``kind`` (item, savings, bad), ``amount`` and
    ``row_hash``.  A savings line counts if the last line before it that is no
    savings line is an item.  A refund line is reduced instead of discounted, for
    as long as it stays negative, so amounts are folded in order.
    """
    order = W.partitionBy(*key).orderBy("pos")
    anchor = F.last(F.when(F.col("kind") != "savings", F.struct("kind", "pos")), ignorenulls=True).over(order)
    marked = lines.withColumn("anchor", anchor)
    belongs = (F.col("kind") == "savings") & F.coalesce(F.col("anchor.kind") == "item", F.lit(False))
    orphans = marked.filter((F.col("kind") == "savings") & ~belongs)
    # an item and its savings lie in one task already
    rest = [c for c in lines.columns if c not in (*key, "pos")]
    group = marked.filter((F.col("kind") == "item") | belongs).groupBy(*key, F.col("anchor.pos").alias("pos")).agg(
        F.first(F.when(F.col("kind") == "item", F.struct(*rest)), ignorenulls=True).alias("own"),
        F.array_sort(F.collect_list(F.when(belongs, F.struct(F.col("pos").alias("at"), "amount")))).alias("savings"),
    )
    items = group.select(*key, "pos", "own.*", "savings").select(*lines.columns, "savings")
    start = F.struct(F.col("amount").alias("price"), F.lit(0).cast("bigint").alias("discount"), F.col("row_hash").alias("hash"))

    def step(acc: Column, s: Column) -> Column:
        off, refund = F.abs(s["amount"]), acc["price"] < 0
        return F.struct(
            F.when(refund, acc["price"] + off).otherwise(acc["price"]).alias("price"),
            F.when(refund, acc["discount"]).otherwise(acc["discount"] + off).alias("discount"),
            F.sha2(F.concat_ws(NUL, acc["hash"], F.lit("savings"), s["amount"].cast("string")), 256).alias("hash"),
        )

    folded = items.withColumn("f", F.aggregate("savings", start, step))
    line_no = F.row_number().over(W.partitionBy(*key).orderBy("pos")).cast("bigint")
    out = folded.withColumn("line_price_cents", F.col("f.price")).withColumn("discount_cents", F.col("f.discount")).withColumn("source_row_hash", F.col("f.hash"))
    return out.withColumn("line_no", line_no).drop("f", "savings", "row_hash"), orphans.drop("anchor", "row_hash")


def read_digital_receipts(spark: SparkSession, path: str, per_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, receipt_items, rejects)."""
    rec = read_records(spark, path, per_line)
    r = "rec."
    barcode, doc_type = F.nullif(F.col(r + "transactionBarcode"), F.lit("")), F.col(r + "documentType")
    purchased = F.coalesce(_iso(F.col(r + "transactionDate")), _iso(F.col(r + "transactionDateTime")), _iso(F.col(r + "transactionDateISO")))
    total = _cents(F.col(r + "total"))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "not valid JSON")
        .when((F.coalesce(doc_type, F.lit("")) != "") & ~doc_type.isin(SUPPORTED_DOCUMENTS), F.concat(F.lit("unsupported documentType '"), doc_type, F.lit("'")))
        .when(barcode.isNull(), "missing transactionBarcode").when(purchased.isNull(), "missing or invalid transactionDate").when(total.isNull(), "missing total")
    )
    refund = F.lower(F.coalesce(F.col(r + "transactionType"), F.lit(""))).contains("refund")
    gas = F.lower(F.coalesce(F.col(r + "receiptType"), F.lit(""))).contains("gas")
    tender = F.get(F.col(r + "tenderArray"), F.lit(0))
    raw = F.when(F.col("reason").isNotNull(), F.coalesce("_corrupt", F.to_json("rec")))
    # the text is parsed once
    judged = cut(rec.withColumn("reason", reason).withColumn("raw", raw).withColumn("_corrupt", F.when(F.col("_corrupt").isNotNull(), "")), "digital-records")
    head = judged.filter("reason IS NULL").select(
        F.col("file"), F.concat_ws(":", F.col("file"), F.col("doc").cast("string"), F.col("seq").cast("string")).alias("entry"), barcode.alias("barcode"),
        F.when(gas, "COSTCO GAS").otherwise("COSTCO WHSE").alias("store"), purchased.alias("purchased_at"), _cents(F.col(r + "subTotal")).alias("subtotal_cents"),
        _cents(F.col(r + "taxes")).alias("tax_cents"), total.alias("total_cents"), F.when(is_card_tender(tender["tenderDescription"]), last4(tender["displayAccountNumber"])).alias("payment_last4"),
        refund.alias("is_refund"), F.when(refund, tender_refund_destination(tender["tenderDescription"])).alias("refund_destination"),
        F.col(r + "invoiceNumber").alias("invoice"), gas.alias("is_gas"), F.col(r + "itemArray").alias("lines"),
    )
    first = trim(F.coalesce("x.itemDescription01", F.lit("")))
    amount = _cents(F.col("x.amount"))
    fuel = F.col("x.fuelUomCode").isNotNull() | F.col("x.fuelGradeCode").isNotNull()
    count = F.when(fuel, _number(F.col("x.fuelUnitQuantity"))).otherwise(_number(F.col("x.unit")))
    quantity = F.when(F.coalesce(count, F.lit(0.0)) == 0, 1.0).otherwise(F.abs(count))
    kind = F.when(amount.isNull(), "bad").when(first.startswith("/"), "savings").otherwise("item")

    def lines_of(heads: DataFrame) -> DataFrame:
        each = heads.select("entry", "barcode", "refund_destination", F.posexplode("lines").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint"))
        return each.select(
            "entry", "barcode", "refund_destination", "pos", kind.alias("kind"), amount.alias("amount"), F.col("x.itemNumber").alias("sku"), first.alias("printed"),
            raw_description(first, trim(F.coalesce("x.itemDescription02", F.lit("")))).alias("raw_description"),
            line_name(_number(F.col("x.itemDepartmentNumber")), first, F.col("x.itemActualName"), fuel, F.col("x.fuelGradeDescription")).alias("canonical_name"),
            quantity.alias("quantity"), _cents(F.col("x.itemUnitPriceAmount")).alias("unit_price_cents"),
        )

    lines = lines_of(head)
    lines = lines.withColumn("row_hash", hash_of(F.col("barcode"), F.col("pos"), F.col("sku"), F.col("amount")))
    items, _ = fold_savings(lines, ["entry"])
    # savings follow an item in every receipt whose first line is no savings line and whose amounts can all be read: the others are few
    unread = F.exists("lines", lambda x: _cents(x["amount"]).isNull())
    opening = trim(F.coalesce(F.get("lines", F.lit(0))["itemDescription01"], F.lit(""))).startswith("/")
    odd = lines_of(head.filter(unread | opening)).withColumn("row_hash", F.lit(None).cast("string"))
    _, orphans = fold_savings(odd, ["entry"])
    # sums need amounts only, and texts would travel with them
    bare = fold_savings(lines.select("entry", "pos", "kind", "amount", F.lit(None).cast("string").alias("row_hash")), ["entry"])[0]
    sums = bare.groupBy("entry").agg(F.count("*").alias("n"), F.sum(F.col("line_price_cents") - F.col("discount_cents")).alias("net"))
    broken = odd.filter("kind = 'bad'").select("entry").union(orphans.select("entry")).distinct().withColumn("broken", F.lit(True))
    expected = F.coalesce("net", F.lit(0)) + F.coalesce("tax_cents", F.lit(0))
    adds_up = (F.coalesce("n", F.lit(0)) > 0) & (F.abs(expected - F.col("total_cents")) <= RECEIPT.arithmetic_tolerance_cents)
    sign_ok = (F.col("total_cents") == 0) | (F.col("is_refund") == (F.col("total_cents") < 0))
    receipts = head.join(sums, "entry", "left").join(broken, "entry", "left").select(
        "file", "entry", F.lit(DIGITAL_SOURCE).alias("source"), "store", "purchased_at", "subtotal_cents", "tax_cents", "total_cents", "payment_last4",
        F.sha2(F.concat(F.lit("costco:"), "barcode"), 256).alias("source_hash"), (F.col("broken").isNotNull() | ~adds_up | ~sign_ok).alias("needs_review"),
        "barcode", "invoice", "is_gas",
    )
    items = items.select(
        "entry", "line_no", "sku", "raw_description", "canonical_name", "quantity", "unit_price_cents", "line_price_cents", "discount_cents",
        "refund_destination", F.col("canonical_name").isNull().alias("needs_review"), "source_row_hash",
    )
    ref = F.when(F.col("reason").isin("missing or invalid transactionDate", "missing total"), barcode).when(F.col("_corrupt").isNotNull(), "file").otherwise(
        F.concat(F.lit("receipt["), F.col("seq").cast("string"), F.lit("]")))
    rejects = judged.filter("reason IS NOT NULL").select(F.lit("receipts").alias("source"), ref.alias("row_ref"), "reason", "raw")
    no_amount = odd.filter("kind = 'bad'").select(
        F.lit("receipts").alias("source"), F.col("barcode").alias("row_ref"), F.concat(F.lit("line without a numeric amount (item "), F.coalesce("sku", F.lit("?")), F.lit(")")).alias("reason"), F.col("raw_description").alias("raw"))
    no_item = orphans.select(
        F.lit("receipts").alias("source"), F.col("barcode").alias("row_ref"), F.concat(F.lit('instant-savings line "'), "printed", F.lit('" has no preceding item')).alias("reason"), F.col("raw_description").alias("raw"))
    return receipts, items, rejects.unionByName(no_amount).unionByName(no_item)

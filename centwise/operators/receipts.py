"""Receipt checks, and receipts built from model readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.config import RECEIPT, ReceiptConfig
from centwise.functions.receipt_lines import FEE_NAMES
from centwise.operators.dictionary import resolve_items

KEY = "household_id"


def check_arithmetic(receipts: DataFrame, items: DataFrame, tolerance: int = RECEIPT.arithmetic_tolerance_cents, fees: DataFrame | None = None) -> DataFrame:
    """Line prices less discounts plus tax and fees against the printed total: adds computed_cents, delta_cents, ok.

    No printed total, or no items, fails.
    """
    sums = items.groupBy("receipt_id").agg(F.sum(F.col("line_price_cents") - F.col("discount_cents")).alias("merchandise_cents"))
    joined = receipts.join(sums, receipts["id"] == sums["receipt_id"], "left").drop("receipt_id")
    extra = F.lit(0)
    if fees is not None:
        paid = fees.groupBy(F.col("receipt_id").alias("id")).agg(F.sum("amount_cents").alias("fee_cents"))
        joined = joined.join(paid, "id", "left")
        extra = F.coalesce("fee_cents", F.lit(0))
    computed = F.coalesce("merchandise_cents", F.lit(0)) + F.coalesce("tax_cents", F.lit(0)) + extra
    delta = computed - F.coalesce("total_cents", F.lit(0))
    ok = F.col("total_cents").isNotNull() & F.col("merchandise_cents").isNotNull() & (F.abs(delta) <= tolerance)
    return joined.withColumn("computed_cents", computed.cast("bigint")).withColumn("delta_cents", delta.cast("bigint")).withColumn("ok", ok)


def sign_ok(is_refund: Column, total: Column) -> Column:
    """A refund has a negative total and a sale has not; a zero total says nothing."""
    return (total == 0) | (is_refund == (total < 0))


def item_needs_review(name_confidence: Column, category_confidence: Column, threshold: float) -> Column:
    unknown = name_confidence.isNull() | F.isnan(name_confidence) | category_confidence.isNull() | F.isnan(category_confidence)
    return unknown | (F.least(name_confidence, category_confidence) < F.lit(threshold))


def build_receipts(extractions: DataFrame, dictionary: DataFrame, answers: DataFrame | None = None, cfg: ReceiptConfig = RECEIPT) -> tuple[DataFrame, DataFrame]:
    """(receipts, receipt_items) from one reading per image.

    An unreadable image becomes a flagged receipt without items, stored under an
    empty store and a zero total.
    """
    # an id is the hash of this text; rows are dealt by the text, since hashes cannot be compressed, and hashed at the end
    rid = F.concat(F.lit("r-"), F.sha2(F.col("_doc"), 256))
    base = extractions.withColumn("_doc", F.concat_ws(":", KEY, "image_hash"))
    lines = base.select(KEY, "_doc", F.coalesce("store", F.lit("")).alias("store"), F.posexplode("lines").alias("pos", "x")).select(
        KEY, "_doc", "store", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("x.sku").alias("sku"), F.col("x.rawDescription").alias("raw_description"),
        F.col("x.quantity").alias("quantity"), F.col("x.unitPrice").alias("unit_price_cents"), F.col("x.linePrice").alias("line_price_cents"), F.col("x.discount").alias("discount_cents"),
    )
    items = resolve_items(lines, dictionary, answers).withColumn(
        "needs_review", item_needs_review(F.col("name_confidence"), F.col("category_confidence"), cfg.review_threshold)
    )
    per = items.groupBy("_doc").agg(
        F.sum("line_price_cents").alias("price"), F.sum("discount_cents").alias("off"), F.max("needs_review").alias("any_review")
    )
    fee = F.aggregate("fees", F.lit(0).cast("bigint"), lambda a, f: a + f["amount"])
    computed = F.coalesce("price", F.lit(0)) - F.coalesce("off", F.lit(0)) + F.coalesce("tax_cents", F.lit(0)) + fee
    ok = F.col("total_cents").isNotNull() & (F.abs(computed - F.col("total_cents")) <= cfg.arithmetic_tolerance_cents)
    receipts = base.join(per, "_doc", "left").select(
        rid.alias("id"), KEY, F.lit("photo").alias("source"), "image_hash", F.coalesce("store", F.lit("")).alias("store"), "purchased_raw",
        F.when(F.col("readable"), F.coalesce(F.col("price") - F.col("off"), F.lit(0))).alias("subtotal_cents"), "tax_cents", F.coalesce("total_cents", F.lit(0)).alias("total_cents"), "payment_last4",
        (~F.col("readable") | ~F.coalesce(ok, F.lit(False)) | F.coalesce("any_review", F.lit(False))).alias("needs_review"), "readable",
    )
    named = items.select(KEY, rid.alias("receipt_id"), *[c for c in items.columns if c not in (KEY, "_doc")])
    return receipts, named.withColumn("id", F.concat("receipt_id", F.lit("-"), F.col("line_no").cast("string")))


def reread(receipts: DataFrame, items: DataFrame, built: DataFrame, built_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, items, outcomes): a new reading replaces only a stored receipt that has no items and the same image.

    Outcomes: replaced, has_items, still_unreadable or not_found.
    """
    held = items.select(F.col("receipt_id").alias("id")).distinct().withColumn("_has", F.lit(True))
    stored = receipts.select(KEY, "image_hash", "id").join(held, "id", "left")
    judged = built.select(KEY, "image_hash", F.col("id").alias("new_id"), "readable").join(stored, [KEY, "image_hash"], "left")
    code = F.when(F.col("id").isNull(), "not_found").when(F.col("_has"), "has_items").when(~F.col("readable"), "still_unreadable").otherwise("replaced")
    outcomes = judged.select(KEY, "image_hash", "id", "new_id", code.alias("outcome"))
    swap = outcomes.filter("outcome = 'replaced'").select("id", "new_id")
    fields = ["store", "purchased_raw", "subtotal_cents", "tax_cents", "total_cents", "payment_last4", "needs_review"]
    fresh = swap.join(built.select(F.col("id").alias("new_id"), F.struct(*fields).alias("f")), "new_id").select("id", "f")
    joined = receipts.join(fresh, "id", "left")
    new_receipts = joined.select(*[F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in receipts.columns])
    moved = (
        built_items.drop("id").withColumnRenamed("receipt_id", "new_id").join(swap.withColumnRenamed("id", "receipt_id"), "new_id").drop("new_id")
        .withColumn("id", F.concat("receipt_id", F.lit("-"), F.col("line_no").cast("string")))
    )
    return new_receipts, items.unionByName(moved, allowMissingColumns=True), outcomes


def build_eval_set(manifest: DataFrame, receipts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected items per captured image, outcome per image).

    An image names its barcode, or the invoice of a gas receipt.  Unnamed and fee
    lines are not expected to be read.
    """
    by_invoice = receipts.filter(F.col("is_gas") & F.col("invoice").isNotNull()).groupBy("invoice").agg(F.max(F.struct("entry", "barcode")).alias("b")).select("invoice", F.col("b.barcode").alias("_barcode"))
    paired = manifest.join(by_invoice, "invoice", "left").withColumn("barcode", F.coalesce("barcode", "_barcode")).drop("_barcode")
    one = receipts.groupBy("barcode").agg(F.max(F.struct("entry", "store", "total_cents")).alias("r")).select("barcode", "r.*")
    found = paired.join(one, "barcode", "left")
    named = items.filter(F.col("canonical_name").isNotNull() & ~F.col("canonical_name").isin(FEE_NAMES)).select(
        "entry", "line_no", "sku", F.col("canonical_name").alias("name"), F.lit(None).cast("string").alias("category")
    )
    expected = found.filter("entry IS NOT NULL").select("file", "entry").join(named, "entry").select("file", "line_no", "sku", "name", "category")
    counts = expected.groupBy("file").agg(F.count("*").alias("expected_items"))
    outcome = F.when(F.col("entry").isNull(), "unpaired").when(F.col("expected_items").isNull(), "skipped_empty").otherwise("written")
    return expected, found.join(counts, "file", "left").select("file", "store", "total_cents", outcome.alias("outcome"), F.coalesce("expected_items", F.lit(0)).alias("expected_items"))

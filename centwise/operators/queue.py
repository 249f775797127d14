"""The review queue: what still needs a person, less what a person already decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from centwise.config import ASK_WINDOW_DAYS
from centwise.functions.dates import within_ask_window
from centwise.functions.receipt_lines import placeholder
from centwise.functions.stores import builtin_chain, has_run, is_fuel, leads, learnable, learned_key
from centwise.functions.text import normalize_merchant, normalize_store, title_case, trim
from centwise.operators.reads import ambiguous_groups, unmatched_transactions

KEY = "household_id"


def learned_stores(receipts: DataFrame) -> DataFrame:
    """Store names a household's own receipts taught: household_id, key, display."""
    names = receipts.filter(trim(F.coalesce("store", F.lit(""))) != "").select(KEY, "store").distinct()
    keyed = names.withColumn("key", learned_key(F.col("store"))).filter(learnable(F.col("key")))
    return keyed.groupBy(KEY, "key").agg(F.min("store").alias("store")).select(KEY, "key", title_case(normalize_store(F.col("store"))).alias("display"))


def receipt_merchants(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """(household_id, normalized_merchant, merchant) for merchants that can give a receipt.

    Built-in chains come first, then learned stores by key.  Learned names are
    found through their first word, on distinct merchants only.
    """
    names = lines.select(KEY, "normalized_merchant").distinct().withColumn("chain", builtin_chain(F.col("normalized_merchant")))
    line = normalize_merchant(F.col("normalized_merchant"))
    open_names = names.filter(F.col("chain").isNull() & (line != "") & ~is_fuel(line)).withColumn("words", normalize_store(line))
    stores = learned_stores(receipts).withColumn("word", F.split("key", " ")[0])
    hits = open_names.withColumn("word", F.explode(F.array_distinct(F.split("words", " ")))).join(stores, [KEY, "word"])
    long_line = F.size(F.split("words", " ")) >= 2
    by_key, by_line = leads(F.col("words"), F.col("key")), leads(F.col("key"), F.col("words")) & long_line
    shown = F.when(by_key, F.col("display")).when(by_line, title_case(F.col("words"))).when(has_run(F.col("words"), F.col("key")), F.col("display"))
    learned = (
        hits.withColumn("shown", shown).filter("shown IS NOT NULL")
        .groupBy(KEY, "normalized_merchant").agg(F.min(F.struct("key", "shown")).alias("s")).select(KEY, "normalized_merchant", F.col("s.shown").alias("merchant"))
    )
    return names.filter("chain IS NOT NULL").select(KEY, "normalized_merchant", F.col("chain").alias("merchant")).unionByName(learned)


def charge_summary(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Bank lines with the merchant name shown to people."""
    shown = receipt_merchants(transactions, receipts)
    return transactions.join(shown, [KEY, "normalized_merchant"], "left").select(
        KEY, "id", F.col("normalized_merchant").alias("merchant"), F.coalesce("merchant", "normalized_merchant").alias("display_merchant"), "amount_cents", "posted_date"
    )


def undecided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    return items.join(decisions.select(KEY, F.col("item_type").alias("type"), F.col("item_id").alias("id")), [KEY, "type", "id"], "left_anti")


def review_queue(
    receipts: DataFrame, receipt_items: DataFrame, transactions: DataFrame, matches: DataFrame, decisions: DataFrame, as_of: str,
) -> DataFrame:
    """Union of the four kinds of open question, in one flat shape."""
    slip = receipts.select(KEY, F.col("id").alias("receipt_id"), "store", "purchased_at", "source")
    photo = F.col("source") == "photo"
    none = F.lit(None).cast("string")
    sku = receipt_items.filter("needs_review").join(slip, [KEY, "receipt_id"]).select(
        KEY, F.lit("sku_resolution").alias("type"), "id", F.concat(F.lit('Low-confidence SKU resolution: "'), "raw_description", F.lit('"')).alias("reason"),
        F.col("line_price_cents").alias("amount_cents"), "receipt_id", "store", F.col("purchased_at").alias("happened_on"), photo.alias("has_image"),
        "sku", "canonical_name", "category_id", F.lit(None).cast("bigint").alias("item_count"),
    )
    groups = ambiguous_groups(matches, transactions)
    ambiguous = groups.select(
        KEY, F.lit("ambiguous_match").alias("type"), F.col("transaction_id").alias("id"),
        F.concat(F.lit("Ambiguous match: "), F.col("candidates").cast("string"), F.when(F.col("candidates") == 1, " candidate").otherwise(" candidates"), F.lit(" for transaction")).alias("reason"),
    )
    asks = unmatched_transactions(transactions, matches).filter(
        (F.col("amount_cents") < 0) & within_ask_window(F.col("posted_date"), F.lit(as_of).cast("date"), ASK_WINDOW_DAYS)
    )
    missing = asks.join(receipt_merchants(asks, receipts), [KEY, "normalized_merchant"]).select(
        KEY, F.lit("missing_receipt").alias("type"), "id", F.concat("merchant", F.lit(" charge — upload the receipt for an item breakdown")).alias("reason"),
        "amount_cents", F.col("merchant").alias("store"), F.col("posted_date").alias("happened_on"),
    )
    counts = receipt_items.groupBy(KEY, F.col("receipt_id").alias("id")).agg(F.count("*").alias("n"))
    blank = placeholder(F.col("store"), F.col("total_cents"))
    flagged = receipts.filter("needs_review").join(counts, [KEY, "id"], "left").select(
        KEY, F.lit("flagged_receipt").alias("type"), "id",
        F.when(blank, "Flagged receipt: photo could not be read").otherwise(F.concat(F.lit("Flagged receipt: arithmetic check failed ("), "store", F.lit(")"))).alias("reason"),
        F.col("total_cents").alias("amount_cents"), F.col("id").alias("receipt_id"), F.when(~blank, F.col("store")).alias("store"),
        F.when(~blank, F.col("purchased_at")).alias("happened_on"), photo.alias("has_image"), F.coalesce("n", F.lit(0)).alias("item_count"),
    )
    queue = sku
    for part in (ambiguous, missing, flagged):
        queue = queue.unionByName(part, allowMissingColumns=True)
    return undecided(queue.withColumn("sku", F.coalesce("sku", none)), decisions)


def queue_for_display(queue: DataFrame) -> DataFrame:
    """Questions first; then missing receipts, newest charge first."""
    offer = F.col("type") == "missing_receipt"
    return queue.withColumn("offer", offer).orderBy("household_id", "offer", F.when(offer, F.col("happened_on")).desc(), "type", "id")

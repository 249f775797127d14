"""Match records written back as stored match rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.functions.money import to_pct
from centwise.functions.taxonomy import category_id_for

KEY = "household_id"
ROW = ["id", KEY, "transaction_id", "order_item_id", "receipt_item_id", "receipt_id", "order_id", "status", "confidence", "method", "rationale", "credit_id"]
COMPARED = ["order_item_id", "receipt_item_id", "receipt_id", "order_id", "status", "confidence", "method", "rationale", "credit_id"]


def expand_matches(matches: DataFrame, receipt_items: DataFrame, order_items: DataFrame) -> DataFrame:
    """One stored row per item of a linked match, items of both sides side by side by position.

    A match in review, or one without items, gives one row; a match without a
    bank line gives none.
    """
    pos_r = F.row_number().over(W.partitionBy(KEY, "receipt_id").orderBy("line_no", "id"))
    pos_o = F.row_number().over(W.partitionBy(KEY, "order_id").orderBy("shipment_id", "item_seq", "id"))
    ri = receipt_items.select(KEY, "receipt_id", F.col("id").alias("receipt_item_id"), pos_r.alias("pos"))
    oi = order_items.filter(~F.col("is_return")).select(KEY, "order_id", F.col("id").alias("order_item_id"), pos_o.alias("pos"))
    n_r = receipt_items.groupBy(KEY, "receipt_id").agg(F.count("*").alias("n_r"))
    n_o = order_items.filter(~F.col("is_return")).groupBy(KEY, "order_id").agg(F.count("*").alias("n_o"))
    linked = F.col("status") == "auto_linked"
    base = (
        matches.filter("transaction_id IS NOT NULL").select(
            KEY, "match_id", "transaction_id", "receipt_id", "order_id", F.col("type").alias("method"), "rationale", "credit_id",
            linked.alias("linked"), F.when(linked, "matched").otherwise("pending").alias("status"), to_pct(F.col("confidence")).alias("confidence"),
        )
        .join(n_r, [KEY, "receipt_id"], "left").join(n_o, [KEY, "order_id"], "left")
        .withColumn("n_r", F.when(F.col("linked"), F.coalesce("n_r", F.lit(0))).otherwise(0))
        .withColumn("n_o", F.when(F.col("linked"), F.coalesce("n_o", F.lit(0))).otherwise(0))
    )
    longest = F.greatest("n_r", "n_o").cast("int")
    spread = (
        base.withColumn("pos", F.explode(F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array(F.lit(0)))))
        .join(ri, [KEY, "receipt_id", "pos"], "left").join(oi, [KEY, "order_id", "pos"], "left")
    )
    both = (F.col("n_r") > 0) & (F.col("n_o") > 0)
    ident = (
        F.when(both, F.concat_ws("-", "match_id", F.coalesce("order_item_id", F.lit("x")), F.coalesce("receipt_item_id", F.lit("x"))))
        .when(F.col("n_o") > 0, F.concat("match_id", F.lit("-oi-"), "order_item_id"))
        .when(F.col("n_r") > 0, F.concat("match_id", F.lit("-ri-"), "receipt_item_id"))
        .otherwise(F.col("match_id"))
    )
    return spread.withColumn("id", F.concat(F.lit("m-"), ident)).select(*ROW).dropDuplicates(["id"])


def sync_matches(existing: DataFrame, desired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, changes): engine-owned rows become ``desired``, rows people touched stay as they are.

    The engine owns ``m-`` rows that are matched or pending.  No pending row is
    wanted on a transaction a person settled, and an id held by a person's row is
    never taken over.  ``changes`` has household_id, id and op.
    """
    owned = F.col("id").startswith("m-") & F.col("status").isin("matched", "pending")
    engine, human = existing.filter(owned).select(*ROW), existing.filter(~owned).select(*ROW)
    settled = existing.filter(F.col("status") == "manual").select(KEY, "transaction_id").distinct().withColumn("_settled", F.lit(True))
    wanted = (
        desired.select(*ROW).join(settled, [KEY, "transaction_id"], "left")
        .filter((F.col("status") != "pending") | F.col("_settled").isNull()).drop("_settled")
        .join(human.select(KEY, "id"), [KEY, "id"], "left_anti").select(*ROW)
    )
    old = engine.select(KEY, "id", F.struct(*COMPARED, "transaction_id").alias("old"))
    new = wanted.select(KEY, "id", F.struct(*COMPARED, "transaction_id").alias("new"))
    joined = old.join(new, [KEY, "id"], "full_outer")
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(same, "keep").otherwise("update")
    labelled = joined.withColumn("op", op)
    kept = labelled.filter("new IS NOT NULL").select(
        "id", KEY, F.coalesce("old.transaction_id", "new.transaction_id").alias("transaction_id"), *[F.col(f"new.{c}").alias(c) for c in COMPARED]
    )
    return human.unionByName(kept.select(*ROW)), labelled.select(KEY, "id", "op")


def stamp_categories(receipt_items: DataFrame, items: DataFrame) -> DataFrame:
    """Fill an empty category of a receipt item from its classified event item."""
    found = items.filter("receipt_item_id IS NOT NULL").groupBy(KEY, F.col("receipt_item_id").alias("id")).agg(F.max("category").alias("_name"))
    return receipt_items.join(found, [KEY, "id"], "left").withColumn("category_id", F.coalesce("category_id", category_id_for(F.col("_name")))).drop("_name")

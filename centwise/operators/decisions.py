"""Review decisions applied in one batch, for all households."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.functions.taxonomy import category_id_for
from centwise.operators.dictionary import upsert

KEY = "household_id"
# Kinds of queue item and of correction.
ITEM_TYPES = ["sku_resolution", "ambiguous_match", "missing_receipt", "flagged_receipt"]
VARIANTS = ["pickCategoryId", "pickMatchCandidateId", "editResolution"]
_PAYLOAD = "variant string, categoryId string, candidateId string, canonicalName string, category string"


@dataclass(frozen=True)
class Decided:
    outcomes: DataFrame
    decisions: DataFrame
    receipt_items: DataFrame
    receipts: DataFrame
    matches: DataFrame
    dictionary: DataFrame


def rename_unmatched(decisions: DataFrame) -> DataFrame:
    """Old ``unmatched_txn`` decisions become ``missing_receipt`` unless that one exists already."""
    new = decisions.filter("item_type = 'missing_receipt'").select(KEY, "item_id", F.lit(True).alias("_there"))
    joined = decisions.join(new, [KEY, "item_id"], "left")
    renamed = F.when((F.col("item_type") == "unmatched_txn") & F.col("_there").isNull(), "missing_receipt").otherwise(F.col("item_type"))
    return joined.withColumn("item_type", renamed).select(decisions.columns)


def _bounded(c: Column, longest: int | None) -> Column:
    return F.coalesce(F.length(c) >= 1 if longest is None else F.length(c).between(1, longest), F.lit(False))


def _judged(decisions: DataFrame, items: DataFrame, receipts: DataFrame, transactions: DataFrame, matches: DataFrame, longest: int | None = None) -> DataFrame:
    """Each decision with what it points at and the refusal code it would get on its own."""
    p = decisions.withColumn("p", F.from_json("payload_json", _PAYLOAD))
    row = items.join(receipts.select(KEY, F.col("id").alias("receipt_id"), "store"), [KEY, "receipt_id"]).select(
        KEY, F.col("id").alias("item_id"),
        F.struct("sku", "raw_description", "canonical_name", "category_id", "name_confidence", "needs_review", "store").alias("item"),
    )
    slip = receipts.select(KEY, F.col("id").alias("item_id"), F.col("needs_review").alias("slip_flag"))
    line = transactions.select(KEY, F.col("id").alias("item_id"), F.lit(True).alias("line"))
    candidate = matches.filter("status = 'pending'").select(
        KEY, F.col("transaction_id").alias("item_id"), F.col("id").alias("_candidate"), F.lit(True).alias("picked")
    )
    joined = (
        p.withColumn("_candidate", F.col("p.candidateId")).join(row, [KEY, "item_id"], "left").join(slip, [KEY, "item_id"], "left")
        .join(line, [KEY, "item_id"], "left").join(candidate, [KEY, "item_id", "_candidate"], "left")
    )
    kind, action, variant = F.col("item_type"), F.col("decision"), F.col("p.variant")
    correct = action == "correct"
    sku_edit = correct & variant.isin("pickCategoryId", "editResolution")
    pick = correct & (variant == "pickMatchCandidateId")
    fields = (
        F.when(variant == "pickCategoryId", _bounded(F.col("p.categoryId"), longest)).when(variant == "pickMatchCandidateId", _bounded(F.col("p.candidateId"), longest))
        .when(variant == "editResolution", _bounded(F.col("p.canonicalName"), longest) & _bounded(F.col("p.category"), longest))
    )
    category = category_id_for(F.when(variant == "pickCategoryId", F.col("p.categoryId")).when(variant == "editResolution", F.col("p.category")))
    of_item = F.when(F.col("item").isNull(), "not_found").when(~F.col("item.needs_review"), "not_queued")
    of_slip = F.when(F.col("slip_flag").isNull(), "not_found").when(~F.col("slip_flag"), "not_queued")
    of_line = F.when(F.col("line").isNull(), "not_found")
    early = F.when(~kind.isin(ITEM_TYPES), "invalid_item_type").when(correct & (F.coalesce(~variant.isin(VARIANTS), F.lit(True)) | ~F.coalesce(fields, F.lit(False))), "invalid_variant")
    late = (
        F.when(sku_edit & (kind != "sku_resolution"), "invalid_variant").when(pick & (kind != "ambiguous_match"), "invalid_variant")
        .when(sku_edit, F.coalesce(of_item, F.when(F.col("_category").isNull(), "unknown_category")))
        .when(pick, F.coalesce(of_line, F.when(F.col("picked").isNull(), "candidate_mismatch")))
        .when(kind == "sku_resolution", of_item).when(kind == "flagged_receipt", of_slip).when(kind == "ambiguous_match", of_line)
        .when(kind == "missing_receipt", F.coalesce(of_line, F.when(action == "confirm", "not_applicable")))
    )
    return joined.withColumn("_category", category).withColumn("_early", early).withColumn("_late", late)


def best_pending(matches: DataFrame) -> DataFrame:
    """Best open candidate per transaction: highest confidence, unknown last, then id."""
    rank = F.struct(-F.coalesce(F.col("confidence"), F.lit(-1)).cast("bigint"), F.col("id").alias("id"))
    return matches.filter("status = 'pending'").groupBy(KEY, "transaction_id").agg(F.min(rank).alias("b")).select(KEY, "transaction_id", F.col("b.id").alias("best"))


def resolve_ambiguity(matches: DataFrame, winners: DataFrame) -> DataFrame:
    """Open rows of a settled transaction: the winner becomes manual, the others rejected."""
    joined = matches.join(winners.select(KEY, "transaction_id", F.col("winner")), [KEY, "transaction_id"], "left")
    settled = F.col("winner").isNotNull() & (F.col("status") == "pending")
    status = F.when(settled & (F.col("id") == F.col("winner")), "manual").when(settled, "rejected").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(matches.columns)


def apply_decisions_batch(
    incoming: DataFrame, decided: DataFrame, receipt_items: DataFrame, receipts: DataFrame, transactions: DataFrame, matches: DataFrame,
    dictionary: DataFrame, now_ms: int, longest_field: int | None = None,
) -> Decided:
    """``incoming``: household_id, seq, item_type, item_id, decision (confirm, dismiss, correct), payload_json.

    The first sound decision on an item is accepted; later ones conflict, as does
    any on an item decided before.  Text fields longer than ``longest_field`` are refused.  A refused one leaves no trace but its code.
    """
    item_key = [KEY, "item_type", "item_id"]
    judged = _judged(incoming, receipt_items, receipts, transactions, matches, longest_field)
    before = decided.select(*item_key, F.lit(True).alias("_before")).distinct()
    judged = judged.join(before, item_key, "left")
    sound = F.col("_early").isNull() & F.col("_late").isNull() & F.col("_before").isNull()
    # judged once: the decisions on an item lie together since the last join
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in item_key])
    judged = judged.withColumn("_first", F.when(known, F.min(F.when(sound, F.col("seq"))).over(W.partitionBy(*item_key))))
    taken = F.coalesce(F.col("_before"), F.lit(False)) | F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    code = F.coalesce("_early", F.when(taken, "conflict"), "_late", F.lit("accepted"))
    judged = judged.withColumn("outcome", code)
    ok = judged.filter("outcome = 'accepted'")

    on_item = ok.filter("item_type = 'sku_resolution'").select(
        KEY, F.col("item_id").alias("id"), F.struct(F.col("decision").alias("act"), F.col("p.variant").alias("variant"), F.col("p.canonicalName").alias("name"), F.col("_category").alias("category")).alias("d")
    )
    items = receipt_items.join(on_item, [KEY, "id"], "left")
    hit, act = F.col("d").isNotNull(), F.col("d.act")
    picked, edited = hit & (F.col("d.variant") == "pickCategoryId"), hit & (F.col("d.variant") == "editResolution")
    sets = {
        "needs_review": F.when(hit, False).otherwise(F.col("needs_review")),
        "name_confidence": F.when(F.coalesce(edited, F.lit(False)) | ((act == "confirm") & F.col("canonical_name").isNotNull()), 1.0).otherwise(F.col("name_confidence")),
        "category_confidence": F.when(F.coalesce(picked | edited, F.lit(False)) | ((act == "confirm") & F.col("category_id").isNotNull()), 1.0).otherwise(F.col("category_confidence")),
        "canonical_name": F.when(edited, F.col("d.name")).otherwise(F.col("canonical_name")),
        "category_id": F.when(picked | edited, F.col("d.category")).otherwise(F.col("category_id")),
    }
    new_items = items.select(*[sets[c].alias(c) if c in sets else F.col(c) for c in receipt_items.columns])

    on_slip = ok.filter("item_type = 'flagged_receipt'").select(KEY, F.col("item_id").alias("id"), F.lit(True).alias("_cleared"))
    new_receipts = receipts.join(on_slip, [KEY, "id"], "left").withColumn("needs_review", F.col("needs_review") & F.col("_cleared").isNull()).select(receipts.columns)

    settled = ok.filter((F.col("item_type") == "ambiguous_match") & (F.col("decision") != "dismiss")).select(KEY, F.col("item_id").alias("transaction_id"), F.col("p.candidateId").alias("pick"))
    winners = settled.join(best_pending(matches), [KEY, "transaction_id"]).select(KEY, "transaction_id", F.coalesce("pick", "best").alias("winner"))

    teach = ok.filter(F.col("p.variant").isin("pickCategoryId", "editResolution"))
    name = F.when(F.col("p.variant") == "editResolution", F.col("p.canonicalName")).otherwise(F.col("item.canonical_name"))
    learned = teach.select(
        KEY, F.col("item.store").alias("store"), F.coalesce("item.sku", "item.raw_description").alias("sku_or_abbrev"), name.alias("canonical_name"), F.col("_category").alias("category"),
        F.when(F.col("p.variant") == "editResolution", 1.0).otherwise(F.coalesce("item.name_confidence", F.lit(0.0))).alias("name_confidence"), F.lit(1.0).alias("category_confidence"),
        F.lit("human").alias("source"), F.lit(now_ms).cast("bigint").alias("updated_at"), "seq",
    ).filter("canonical_name IS NOT NULL")
    outcomes = judged.select(KEY, "seq", "item_type", "item_id", "decision", "outcome")
    stored = decided.select(*item_key).unionByName(ok.select(*item_key))
    return Decided(outcomes, stored, new_items, new_receipts, resolve_ambiguity(matches, winners), upsert(dictionary, learned))

"""Recurring charges: one merchant, near-equal amounts, about a month apart every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.config import ReconcileConfig, RECONCILE
from centwise.functions.money import half_up
from centwise.operators.candidates import KEY
from centwise.operators.rollup import first_items
from centwise.storage import cut

GROUP = [KEY, "merchant"]


def charges(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with the merchant their first item names; ``unknown`` where there is none."""
    named = F.regexp_extract("rationale", r"(?s)^merchant: ([^;]*);", 1)
    merchant = F.when(F.col("rationale").rlike(r"(?s)^merchant: [^;]*;"), named).otherwise("unknown")
    first = first_items(items).select(KEY, "event_id", "category", "rationale")
    return events.join(first, [KEY, "event_id"], "left").select(
        KEY, "event_id", "signed_spend_cents", "occurred_on", "category", F.coalesce(merchant, F.lit("unknown")).alias("merchant")
    )


def amount_anchors(amounts: DataFrame, tolerance: int) -> DataFrame:
    """Anchor of every distinct (household, merchant, amount).

    Ascending, an amount joins the group of the current anchor while it lies
    within ``tolerance`` of that anchor, else it becomes the next anchor.  So
    anchors are the amounts with none in reach below, and whatever pointers reach
    from there that lead from each amount to the first one beyond its tolerance.
    Pointers are followed by doubling, in joins.

    Amounts are dealt into cells one tolerance and a cent wide: neighbours and
    pointers end in the next two cells, a cell holds ``tolerance`` + 1 amounts at
    most, and no merchant is gathered in one task.
    """
    width = tolerance + 1
    at = F.floor(F.col("signed_spend_cents") / width)
    cell = [*GROUP, "cell"]
    cells = cut(amounts.select(*GROUP, "signed_spend_cents").distinct().groupBy(*GROUP, at.alias("cell")).agg(F.array_sort(F.collect_list("signed_spend_cents")).alias("own")), "amount-cells")
    moved = lambda by, value, name: cells.select(*GROUP, (F.col("cell") + by).alias("cell"), value.alias(name))
    around = (
        cells.join(moved(1, F.array_max("own"), "below"), cell, "left").join(moved(-1, F.col("own"), "next_one"), cell, "left").join(moved(-2, F.array_min("own"), "next_two"), cell, "left")
    )
    each = around.select(*GROUP, "cell", "own", "below", "next_one", "next_two", F.posexplode("own").alias("i", "amount"))
    before = F.when(F.col("i") > 0, F.get("own", F.col("i") - 1)).otherwise(F.col("below"))
    beyond = F.coalesce(F.array_min(F.filter("next_one", lambda y: y >= F.col("amount") + width)), F.col("next_two"))
    linked = cut(each.select(*GROUP, "cell", "amount", F.coalesce(F.col("amount") - before > tolerance, F.lit(True)).alias("starts"), beyond.alias("beyond")), "amounts")
    anchors = linked.filter("starts").select(*GROUP, "amount")
    inner = linked.filter("NOT starts").select(*GROUP, F.col("amount").alias("beyond"))
    hops = cut(linked.join(inner, [*GROUP, "beyond"]).select(*GROUP, "amount", "beyond"), "hops")
    while not hops.isEmpty():
        reached = anchors.join(hops, [*GROUP, "amount"]).select(*GROUP, F.col("beyond").alias("amount"))
        anchors = cut(anchors.union(reached).distinct(), "anchors")
        further = hops.select(*GROUP, F.col("amount").alias("beyond"), F.col("beyond").alias("far"))
        hops = cut(hops.join(further, [*GROUP, "beyond"]).select(*GROUP, "amount", F.col("far").alias("beyond")), "hops")
    # a cell has one anchor at most; an amount's own is in its cell or the one below
    placed = anchors.select(*GROUP, F.explode(F.sequence(F.floor(F.col("amount") / width), F.floor(F.col("amount") / width) + 1)).alias("cell"), F.col("amount").alias("anchor"))
    near = linked.select(*GROUP, "cell", "amount").join(placed, cell).filter((F.col("anchor") <= F.col("amount")) & (F.col("amount") - F.col("anchor") <= tolerance))
    return near.groupBy(*GROUP, F.col("amount").alias("signed_spend_cents")).agg(F.max("anchor").alias("anchor"))


def detect_recurring(events: DataFrame, items: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """One row per recurring event: household_id, event_id, merchant, category, cadence_days, rationale."""
    # both are read twice
    all_charges = cut(charges(events, items), "charges")
    anchored = cut(all_charges.join(amount_anchors(all_charges, cfg.recurring_tolerance_cents), GROUP + ["signed_spend_cents"]), "anchored")
    group = GROUP + ["anchor"]
    daily = anchored.groupBy(*group, "occurred_on").agg(F.count("*").alias("n"), F.min("signed_spend_cents").alias("cents"))
    gap = F.date_diff("occurred_on", F.lag("occurred_on").over(W.partitionBy(*group).orderBy("occurred_on")))
    slack = cfg.recurring_cadence_slack_days
    steady = F.coalesce(gap.between(cfg.recurring_cadence_days - slack, cfg.recurring_cadence_days + slack), F.lit(True)) & (F.col("n") == 1)
    regular = (
        daily.withColumn("steady", steady).groupBy(*group)
        .agg(F.count("*").alias("days"), F.bool_and("steady").alias("steady"), F.min(F.struct("occurred_on", "cents")).alias("first"), F.max("occurred_on").alias("last"))
        .filter(F.col("steady") & (F.col("days") >= 2))
    )
    cadence = half_up(F.date_diff("last", "first.occurred_on") / (F.col("days") - 1).cast("double"))
    regular = regular.select(*group, cadence.alias("cadence_days"), F.abs("first.cents").alias("first_cents"))
    category = F.when(F.col("category").isin("Housing", "Utilities"), F.col("category")).otherwise("Subscriptions")
    dollars = F.concat(F.floor(F.col("first_cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("first_cents") % 100).cast("string"), 2, "0"))
    return anchored.join(regular, group).withColumn("category", category).select(
        KEY, "event_id", "merchant", "category", "cadence_days",
        F.concat(
            F.lit("merchant: "), "merchant", F.lit("; recurring $"), dollars, F.lit("/mo (cadence: ~"), F.col("cadence_days").cast("string"), F.lit("d) → "), F.col("category"),
        ).alias("rationale"),
    )

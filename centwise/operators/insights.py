"""Flags about a household's latest month."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.config import ReconcileConfig, RECONCILE
from centwise.functions.dates import month_index, month_of, month_text
from centwise.functions.money import delta_pct, half_up
from centwise.functions.rules import merchant_from_rationale
from centwise.operators.candidates import KEY


def latest_month(events: DataFrame) -> DataFrame:
    return events.groupBy(KEY).agg(month_index(F.max("occurred_on")).alias("current"))


def merchant_month_spend(events: DataFrame, items: DataFrame) -> DataFrame:
    """Positive spend per merchant and month; the merchant is the first one an item of the event names."""
    named = items.filter(F.col("rationale").startswith("merchant: ")).groupBy(KEY, "event_id").agg(F.min(F.struct("item_rank", "rationale")).alias("t"))
    named = named.select(KEY, "event_id", merchant_from_rationale(F.col("t.rationale")).alias("merchant")).filter(F.col("merchant") != "")
    spent = events.filter(F.col("signed_spend_cents") > 0).select(KEY, "event_id", "signed_spend_cents", month_index(F.col("occurred_on")).alias("month_idx"))
    return spent.join(named, [KEY, "event_id"]).groupBy(KEY, "merchant", "month_idx").agg(F.sum("signed_spend_cents").alias("cents"))


def _flag(df: DataFrame, code: str, subject, observed, comparison, basis, message, inconclusive) -> DataFrame:
    return df.select(
        KEY, F.lit(code).alias("code"), subject.alias("subject"), message.alias("message"), observed.alias("observed_cents"),
        comparison.alias("comparison_cents"), F.when(comparison.isNotNull(), delta_pct(observed, comparison)).alias("delta_pct"),
        basis.alias("basis"), inconclusive.alias("inconclusive"),
    )


def merchant_above_average(events: DataFrame, items: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """Latest month against the mean of the N calendar months before it, all of which must exist."""
    n = cfg.insight_months
    before = W.partitionBy(KEY, "merchant").orderBy("month_idx").rangeBetween(-n, -1)
    spend = merchant_month_spend(events, items).withColumn("prior", F.count("*").over(before)).withColumn("total", F.sum("cents").over(before))
    now = spend.join(latest_month(events), KEY).filter(F.col("month_idx") == F.col("current"))
    short = F.col("prior") < n
    average = F.when(~short, half_up(F.col("total") / F.col("prior").cast("double")))
    fires = now.withColumn("average", average).filter(F.when(short, F.col("prior") >= 1).otherwise(F.col("cents") > F.col("average")))
    return _flag(
        fires, "merchant_above_avg", F.col("merchant"), F.col("cents"), F.col("average"),
        F.when(short, "insufficient_history").otherwise(F.concat(F.lit(f"{n}-month avg for "), "merchant")),
        F.when(short, F.concat(F.lit("Insufficient history to compare "), "merchant", F.lit(" spend"))).otherwise(
            F.concat("merchant", F.lit(f" spend this month is above the {n}-month average"))),
        short,
    )


def category_over_last_month(rollup: DataFrame, events: DataFrame) -> DataFrame:
    """``rollup`` cells of the latest month against the month before; a gap in the months is no baseline."""
    idx = (F.substring("month", 1, 4).cast("bigint") * 12 + F.substring("month", 6, 2).cast("bigint") - 1)
    cells = rollup.select(KEY, "category", idx.alias("month_idx"), F.col("net_spend_cents").alias("cents"))
    earlier = cells.select(KEY, "category", (F.col("month_idx") + 1).alias("month_idx"), F.col("cents").alias("before"))
    now = cells.join(latest_month(events), KEY).filter((F.col("month_idx") == F.col("current")) & (F.col("cents") > 0))
    joined = now.join(earlier, [KEY, "category", "month_idx"], "left")
    blank = F.col("before").isNull() | (F.col("before") <= 0)
    fires = joined.filter(blank | (F.col("cents") > F.col("before")))
    return _flag(
        fires, "category_tracking_over", F.col("category"), F.col("cents"), F.when(~blank, F.col("before")),
        F.when(blank, "insufficient_history").otherwise(F.concat(F.lit("prior month ("), month_text(F.col("month_idx") - 1), F.lit(") for "), "category")),
        F.when(blank, F.concat(F.lit("No meaningful prior-month baseline to compare "), "category", F.lit(" spend"))).otherwise(
            F.concat("category", F.lit(" spend is tracking above last month"))),
        blank,
    )


def new_recurring_charge(events: DataFrame, recurring: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """Recurring merchants first seen inside the last N months."""
    n = cfg.insight_months
    merchant = merchant_from_rationale(F.col("rationale"))
    seen = (
        events.filter(F.col("signed_spend_cents") > 0)
        .join(recurring.select(KEY, "event_id", merchant.alias("merchant")).filter(F.col("merchant") != ""), [KEY, "event_id"])
        .join(latest_month(events), KEY)
        .withColumn("month_idx", month_index(F.col("occurred_on")))
    )
    order = F.struct("occurred_on", "event_id", "signed_spend_cents")
    by = seen.groupBy(KEY, "merchant", "current").agg(
        F.min(order).alias("first"), F.max(F.when(F.col("month_idx") == F.col("current"), order)).alias("latest")
    )
    start = month_index(F.col("first.occurred_on"))
    fires = by.filter(start >= F.col("current") - (n - 1))
    amount = F.coalesce("latest.signed_spend_cents", "first.signed_spend_cents")
    return _flag(
        fires, "new_recurring_charge", F.col("merchant"), amount, F.lit(None).cast("bigint"),
        F.concat(F.lit("new subscription first seen "), month_of(F.col("first.occurred_on")), F.lit(f", within last {n} months")),
        F.concat(F.lit("New recurring charge for "), "merchant", F.lit(" detected")), F.lit(False),
    )


def derive_insights(events: DataFrame, items: DataFrame, rollup: DataFrame, recurring: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    return (
        merchant_above_average(events, items, cfg)
        .unionByName(category_over_last_month(rollup, events))
        .unionByName(new_recurring_charge(events, recurring, cfg))
    )

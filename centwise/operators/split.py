"""An order charged in several parts: the exact subset of nearby charges that adds up to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from centwise.config import ReconcileConfig, RECONCILE
from centwise.functions.dates import day_number, days_between
from centwise.operators.candidates import KEY, payable_orders, retailer_debits
from centwise.operators.cells import cell, touched


#: Pools of at most this many amounts hold their sums one by one, 2^n at most, not as bits.
FEW = 6


def _shifted(bits: Column, by: Column) -> Column:
    """A bit set in 64-bit words moved up by ``by`` places; what leaves its last word is lost."""
    words, places = F.floor(by / 64).cast("int"), (by % 64).cast("int")
    none = F.lit(0).cast("bigint")
    low = lambda i: F.call_function("shiftleft", F.coalesce(F.get(bits, i - words), none), places)
    carried = lambda i: F.call_function("shiftrightunsigned", F.coalesce(F.get(bits, i - words - 1), none), 64 - places)
    return F.transform(F.sequence(F.lit(0), F.size(bits) - 1), lambda i: F.when(places > 0, low(i).bitwiseOR(carried(i))).otherwise(low(i)))


def _holds(bits: Column, value: Column) -> Column:
    word = F.coalesce(F.get(bits, F.floor(value / 64).cast("int")), F.lit(0).cast("bigint"))
    return (value >= 0) & (F.call_function("shiftrightunsigned", word, F.pmod(value, F.lit(64)).cast("int")).bitwiseAND(1) == 1)


def first_exact_subset(amounts: Column, target: Column) -> Column:
    """Places (from 0) of the first subset, in depth-first order, that sums to ``target``; empty if none.

    ``reach[i]`` is the set of sums up to ``target`` that the amounts from place i
    on can make, one bit for each cent in 64-bit words.  A pool of n amounts holds
    (n + 1) * (target / 8 + 8) bytes at most: 7.7 MB for 40 charges and 15,000
    dollars.  The walk takes an amount whenever the rest can still be made.  A few
    amounts make fewer sums than there are words, so theirs are held as numbers.
    """
    enough = F.aggregate(amounts, F.lit(0).cast("bigint"), lambda s, x: s + x) >= target
    found = F.when(F.size(amounts) <= FEW, _walk(amounts, target, *_numbers(target))).otherwise(_walk(amounts, target, *_bits(target)))
    return F.when(enough, found).otherwise(F.array().cast("array<int>"))


def _numbers(target: Column):
    """The sum of nothing, the sums with one amount more, and a test, for sums held as numbers."""
    more = lambda sums, x: F.array_distinct(F.concat(sums, F.filter(F.transform(sums, lambda s: s + x), lambda s: s <= target)))
    return F.array(F.lit(0).cast("bigint")), more, F.array_contains


def _bits(target: Column):
    """The same for sums held as bits."""
    none = F.transform(F.sequence(F.lit(0), F.floor(target / 64).cast("int")), lambda i: F.when(i == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return none, lambda bits, x: F.zip_with(bits, _shifted(bits, x), lambda a, b: a.bitwiseOR(b)), _holds


def _walk(amounts: Column, target: Column, nothing: Column, more, holds) -> Column:
    none = F.array().cast("array<int>")
    reach = F.aggregate(F.reverse(amounts), F.array(nothing), lambda acc, x: F.concat(F.array(more(acc[0], x)), acc))

    def step(walk: Column, i: Column) -> Column:
        left = walk["left"] - F.get(amounts, i)
        take = (walk["left"] > 0) & holds(F.get(walk["reach"], i + 1), left)
        return F.struct(F.when(take, left).otherwise(walk["left"]).alias("left"), F.when(take, F.concat(walk["chosen"], F.array(i))).otherwise(walk["chosen"]).alias("chosen"), walk["reach"].alias("reach"))

    start = F.struct(target.alias("left"), none.alias("chosen"), reach.alias("reach"))
    return F.aggregate(F.sequence(F.lit(0), F.size(amounts) - 1), start, step, lambda walk: F.when(walk["left"] == 0, walk["chosen"]).otherwise(none))


def order_split(bank: DataFrame, orders: DataFrame, direct: DataFrame, cfg: ReconcileConfig = RECONCILE) -> DataFrame:
    """Split-charge candidates for the orders that have no direct one."""
    lines = retailer_debits(bank)
    open_orders = payable_orders(orders).join(direct.select(KEY, "order_id"), [KEY, "order_id"], "left_anti")
    win = cfg.order_window_days
    # a charge above the order's total is in no subset
    pool = (
        open_orders.withColumn("day_cell", F.explode(touched(day_number(F.col("order_date")), win)))
        .join(lines.withColumn("day_cell", cell(day_number(F.col("posted_date")), win)), [KEY, "day_cell"]).filter(F.col("bank_cents") <= F.col("order_total_cents"))
        .withColumn("date_diff", days_between(F.col("posted_date"), F.col("order_date"))).filter(F.col("date_diff") <= win)
        .groupBy(KEY, "order_id", "external_order_id", "order_date", "order_total_cents")
        .agg(F.array_sort(F.collect_list(F.struct("transaction_id", "bank_cents", "date_diff"))).alias("pool"))
    )
    places = first_exact_subset(F.col("pool")["bank_cents"], F.col("order_total_cents"))
    return (
        pool.filter(F.size("pool") >= 2).withColumn("places", places)
        .filter(F.size("places") >= 2)
        .withColumn("chosen", F.transform("places", lambda i: F.get("pool", i)))
        .withColumn("transaction_ids", F.col("chosen")["transaction_id"])
        .withColumn("max_days", F.array_max(F.col("chosen")["date_diff"]))
        .withColumn("confidence", F.lit(0.85) * (F.lit(1.0) - F.col("max_days") / F.lit(float(win))) + F.lit(0.15))
        .drop("pool", "places")
    )

"""Corrections to a ledger: reclassify items, reject matches, relink matches."""

from __future__ import annotations

from dataclasses import replace
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from centwise.operators.candidates import KEY
from centwise.plans.reconcile import Ledger
from centwise.storage import cut


def reclassify(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """``corrections``: household_id, seq, receipt_item_id, order_item_id, new_category.

    Every reference a correction gives must match the item; the last one wins.
    An item carries one reference, so a correction giving both matches nothing.
    """
    said = corrections.filter(F.col("receipt_item_id").isNull() != F.col("order_item_id").isNull())
    item_id = F.coalesce("receipt_item_id", "order_item_id")
    side = F.col("receipt_item_id").isNotNull()
    last = said.groupBy(KEY, side.alias("_side"), item_id.alias("_item")).agg(F.max(F.struct("seq", "new_category")).alias("c"))
    last = last.select(KEY, "_side", "_item", F.col("c.new_category").alias("_new"))
    keyed = items.withColumn("_side", side).withColumn("_item", item_id)
    return keyed.join(last, [KEY, "_side", "_item"], "left").withColumn("category", F.coalesce("_new", "category")).drop("_side", "_item", "_new")


def reject(ledger: Ledger, rejected: DataFrame) -> Ledger:
    """Drop the named matches (household_id, match_id) and the events on their transactions."""
    gone = ledger.matches.join(rejected.select(KEY, "match_id"), [KEY, "match_id"], "left_semi")
    lines = gone.filter("transaction_id IS NOT NULL").select(KEY, "transaction_id").distinct()
    events = ledger.events.join(lines, [KEY, "transaction_id"], "left_anti")
    return replace(
        ledger, events=events, matches=ledger.matches.join(rejected.select(KEY, "match_id"), [KEY, "match_id"], "left_anti"),
        items=ledger.items.join(events.select(KEY, "event_id"), [KEY, "event_id"], "left_semi"),
    )


def relink(ledger: Ledger, moves: DataFrame) -> Ledger:
    """Move matches to other transactions: ``moves`` has household_id, match_id, new_transaction_id.

    Where both transactions have an event, the two events trade transaction and
    date; where only the old one has, it is re-pointed.  Moves of one call must
    not touch the same transaction twice.
    """
    wanted = ledger.matches.join(moves, [KEY, "match_id"]).filter("transaction_id IS NOT NULL").select(
        KEY, "match_id", F.col("transaction_id").alias("old_tx"), F.col("new_transaction_id").alias("new_tx")
    )
    first = ledger.events.filter("transaction_id IS NOT NULL").groupBy(KEY, "transaction_id").agg(F.min(F.struct("event_id", "occurred_on")).alias("e"))
    old = first.select(KEY, F.col("transaction_id").alias("old_tx"), F.col("e").alias("old_event"))
    new = first.select(KEY, F.col("transaction_id").alias("new_tx"), F.col("e").alias("new_event"))
    pairs = wanted.join(old, [KEY, "old_tx"]).join(new, [KEY, "new_tx"], "left")
    there = pairs.select(KEY, F.col("old_event.event_id").alias("event_id"), F.col("new_tx").alias("_tx"), F.col("new_event.occurred_on").alias("_on"))
    back = pairs.filter("new_event IS NOT NULL").select(
        KEY, F.col("new_event.event_id").alias("event_id"), F.col("old_tx").alias("_tx"), F.col("old_event.occurred_on").alias("_on")
    )
    events = (
        ledger.events.join(there.unionByName(back), [KEY, "event_id"], "left")
        .withColumn("transaction_id", F.coalesce("_tx", "transaction_id")).withColumn("occurred_on", F.coalesce("_on", "occurred_on")).drop("_tx", "_on")
    )
    matches = (
        ledger.matches.join(moves.select(KEY, "match_id", "new_transaction_id"), [KEY, "match_id"], "left")
        .withColumn("transaction_id", F.coalesce("new_transaction_id", "transaction_id")).drop("new_transaction_id")
    )
    return replace(ledger, events=events.select(ledger.events.columns), matches=matches.select(ledger.matches.columns))


def relink_in_order(ledger: Ledger, moves: DataFrame) -> Ledger:
    """``relink`` for moves that build on each other: ``moves`` has a ``seq`` as well, and may touch a transaction many times.

    A household's moves are composed into where each touched match and event
    ends; that mapping is joined once, however many moves there are.  Only what
    the moves name is gathered, so a group is as long as its list of moves.
    """
    given = cut(moves.filter("new_transaction_id IS NOT NULL").select(KEY, "seq", "match_id", "new_transaction_id"), "moves")
    named = ledger.matches.join(given.select(KEY, "match_id").distinct(), [KEY, "match_id"], "left_semi").select(KEY, F.lit("match").alias("kind"), F.col("match_id").alias("id"), "transaction_id", F.lit(None).cast("date").alias("occurred_on"))
    touched = named.select(KEY, "transaction_id").union(given.select(KEY, "new_transaction_id")).distinct()
    events = ledger.events.join(touched, [KEY, "transaction_id"], "left_semi").select(KEY, F.lit("event").alias("kind"), F.col("event_id").alias("id"), "transaction_id", "occurred_on")
    ends = f"{KEY} string, kind string, id string, _tx string, _on date"
    final = given.groupBy(KEY).cogroup(named.unionByName(events).groupBy(KEY)).applyInPandas(_composed, ends)
    new_tx = final.filter("kind = 'match'").select(KEY, F.col("id").alias("match_id"), "_tx")
    new_event = final.filter("kind = 'event'").select(KEY, F.col("id").alias("event_id"), "_tx", "_on", F.lit(True).alias("_moved"))
    matches = ledger.matches.join(new_tx, [KEY, "match_id"], "left").withColumn("transaction_id", F.coalesce("_tx", "transaction_id"))
    moved = ledger.events.join(new_event, [KEY, "event_id"], "left").withColumn("transaction_id", F.coalesce("_tx", "transaction_id")).withColumn("occurred_on", F.when(F.col("_moved"), F.col("_on")).otherwise(F.col("occurred_on")))
    return replace(ledger, events=moved.select(ledger.events.columns), matches=matches.select(ledger.matches.columns))


def _composed(moves: pd.DataFrame, things: pd.DataFrame) -> pd.DataFrame:
    """Where one household's touched matches and events are after all its moves."""
    at, when, holds = {}, {}, {}
    for kind, ident, tx, on in zip(things["kind"], things["id"], things["transaction_id"], things["occurred_on"]):
        at[kind, ident] = tx
        if kind == "event":
            when[ident] = on
            holds.setdefault(tx, set()).add(ident)
    for match, new in moves.sort_values("seq")[["match_id", "new_transaction_id"]].itertuples(index=False):
        if ("match", match) not in at:
            continue
        old, at["match", match] = at["match", match], new
        here, there = (min(holds[t], default=None) if t in holds else None for t in (old, new))
        if here is None or here == there:
            continue
        for event, source, target in ((here, old, new), (there, new, old)):
            if event is not None:
                holds[source].discard(event)
                holds.setdefault(target, set()).add(event)
                at["event", event] = target
        if there is not None:
            when[here], when[there] = when[there], when[here]
    household = moves[KEY].iloc[0] if len(moves) else None
    rows = [(household, kind, ident, tx, when.get(ident) if kind == "event" else None) for (kind, ident), tx in at.items() if household is not None]
    return pd.DataFrame(rows, columns=[KEY, "kind", "id", "_tx", "_on"])


def apply_corrections(ledger: Ledger, corrections: list[dict]) -> Ledger:
    """Apply a short ordered list, e.g. one person's edits in a session.

    Each entry has ``kind`` (reclassify_item, reject_match, relink_match) and the
    fields of that kind.  Neighbouring entries of one kind go in one join.
    """
    spark = ledger.events.sparkSession
    for kind, run in groupby(corrections, key=lambda c: c["kind"]):
        batch = list(run)
        if kind == "reclassify_item":
            rows = [(c["household_id"], i, c.get("receipt_item_id"), c.get("order_item_id"), c["new_category"]) for i, c in enumerate(batch)]
            frame = spark.createDataFrame(rows, f"{KEY} string, seq int, receipt_item_id string, order_item_id string, new_category string")
            ledger = replace(ledger, items=reclassify(ledger.items, frame))
        elif kind == "reject_match":
            ledger = reject(ledger, spark.createDataFrame([(c["household_id"], c["match_id"]) for c in batch], f"{KEY} string, match_id string"))
        elif kind == "relink_match":
            rows = [(c["household_id"], i, c["match_id"], c["new_transaction_id"]) for i, c in enumerate(batch)]
            ledger = relink_in_order(ledger, spark.createDataFrame(rows, f"{KEY} string, seq int, match_id string, new_transaction_id string"))
        else:
            raise ValueError(f"unknown correction {kind!r}")
    return ledger

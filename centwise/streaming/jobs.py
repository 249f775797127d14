"""Streaming jobs: file-drop ingest, bank feed, and reconciliation after each write.

Every batch writes into a folder named after its batch number, replacing it if
the batch is run again, so a restart from the checkpoint never counts a file
twice.  State is a log of row versions in folders by key (see ``keyed``): a batch
reads the buckets of its own keys; the newest version of an id is current.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from centwise.operators.feed import FIELDS, STATE, STATE_SCHEMA, advancing, apply_feed, known_accounts
from centwise.operators.load import insert_or_ignore
from centwise.sources.feed import page_changes, stream_feed
from centwise.storage import cut
from centwise.streaming.keyed import KeyedLog, buckets_of, store, stored


def ingest_drops(stream: DataFrame, keys: list[str], table: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None):
    """Append new rows of a streamed drop folder to ``table``; re-dropped rows add nothing."""
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields}

    def step(batch: DataFrame, batch_id: int) -> None:
        # whether a key is there already is all that a later batch asks
        log = KeyedLog(batch.sparkSession, table, ", ".join(kinds[k] for k in keys), keys)
        log.write(insert_or_ignore(log.before(batch_id, batch), batch, keys), batch_id)
        if after is not None:
            after(stored(batch.sparkSession, f"{table}/batch_id={batch_id}", ", ".join(kinds.values())).drop("bucket"), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LOG = STATE_SCHEMA + ", deleted boolean"


def current_rows(log: DataFrame) -> DataFrame:
    """Newest version of each line; deleted ones are gone."""
    rest = [c for c in STATE if c != "id"]
    last = log.groupBy("id").agg(F.max(F.struct("version", "deleted", *rest)).alias("v"))
    return last.filter("NOT v.deleted").select("id", *[F.col(f"v.{c}").alias(c) for c in rest], F.col("v.deleted").alias("deleted"), F.col("v.version").alias("version"))


def feed_state(spark: SparkSession, log_path: str) -> DataFrame:
    """All current lines; for reports, a batch reads its own accounts' only."""
    return current_rows(stored(spark, log_path, f"{_LOG}, version bigint")).select(*STATE)


def feed_log(spark: SparkSession, log_path: str) -> KeyedLog:
    """Lines by account: an id and the pending line that it replaces are of one account."""
    return KeyedLog(spark, log_path, _LOG, ["account_id"], current_rows)


def sync_feed(spark: SparkSession, pages_path: str, accounts: DataFrame, log_path: str, checkpoint: str, files_per_trigger: int | None = None, after: Callable[[DataFrame, int], None] | None = None):
    """Fold landed feed pages into the log of line versions.

    A batch appends only the lines it changed; a login whose cursor stands still
    is folded up to that page.  ``after`` gets the changed lines.
    """
    def step(pages: DataFrame, batch_id: int) -> None:
        log = feed_log(spark, log_path)
        changes, _ = known_accounts(page_changes(advancing(pages)), accounts)
        changes = cut(changes, "changes")
        state = log.before(batch_id, changes).select(*STATE)
        # only lines that share an id with a change can be affected
        named = changes.select("account_id", "external_id").union(changes.select("account_id", F.col("pending_external_id"))).filter("external_id IS NOT NULL").distinct()
        by_id = state.join(named, ["account_id", "external_id"], "left_semi")
        by_pending = state.join(named.withColumnRenamed("external_id", "pending_external_id"), ["account_id", "pending_external_id"], "left_semi")
        touched = cut(by_id.unionByName(by_pending).distinct().select(*STATE), "touched")
        result = apply_feed(touched, changes)
        same = touched.select(*[F.col(c) if c == "id" else F.col(c).alias(f"_{c}") for c in STATE])
        still = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ["account_id", "external_id", *FIELDS]]
        unchanged = still[0]
        for s in still[1:]:
            unchanged = unchanged & s
        changed = result.rows.join(same, "id", "left").filter(F.col("_account_id").isNull() | ~unchanged).select(*STATE, F.lit(False).alias("deleted"))
        gone = touched.join(result.deleted, "id", "left_semi").select(*STATE, F.lit(True).alias("deleted"))
        log.write(changed.unionByName(gone), batch_id)
        if after is not None:
            after(log.batch(batch_id).drop("bucket"), batch_id)

    stream = stream_feed(spark, pages_path, files_per_trigger)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched_households(changed: DataFrame, key: str = "household_id") -> DataFrame:
    return changed.select(key).distinct()


def of_households(df: DataFrame, households: DataFrame) -> DataFrame:
    return df.join(households, "household_id", "left_semi")


def rederive(inputs, changed: DataFrame, reconcile: Callable, out: str, batch_id: int) -> None:
    """Reconcile only the households a write touched and store their match records.

    The write itself is already committed, so a failure here loses no import.
    """
    from dataclasses import fields, replace

    households = cut(touched_households(changed), "touched")
    scoped = replace(inputs, **{f.name: of_households(getattr(inputs, f.name), households) for f in fields(inputs)})
    reconcile(scoped).matches.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def store_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Household tables in folders by household; their schemas."""
    for name, df in tables.items():
        store(df, f"{folder}/{name}", ["household_id"])
    return {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) for name, df in tables.items()}


def touched_tables(spark: SparkSession, folder: str, schemas: dict[str, str], changed: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``store_tables`` in the buckets of the households that ``changed`` names; other folders aren't read."""
    wanted = buckets_of(changed, ["household_id"])
    return {name: stored(spark, f"{folder}/{name}", schema, wanted).drop("bucket") for name, schema in schemas.items()}

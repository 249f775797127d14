"""Bank change feed folded into stored lines.

Changes only meet through the ids they name: a posted line and the pending line
it replaces.  Those ids form small chains, so the feed is partitioned by chain,
not by account, and each chain is replayed in feed order in one streaming pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from centwise.storage import cut

FIELDS = ["posted_date", "amount_cents", "raw_merchant", "normalized_merchant", "pending", "pending_external_id", "category_hint"]
STATE = ["id", "account_id", "external_id", *FIELDS]
STATE_SCHEMA = (
    "id string, account_id string, external_id string, posted_date date, amount_cents bigint, raw_merchant string, normalized_merchant string, "
    "pending boolean, pending_external_id string, category_hint string"
)
_OUT = f"what string, {STATE_SCHEMA}"


@dataclass(frozen=True)
class FeedResult:
    rows: DataFrame
    reset: DataFrame
    deleted: DataFrame
    counts: DataFrame


def known_accounts(changes: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes with account_id, number of changes per login that name an unreported account)."""
    ours = accounts.select("login_id", "external_account_id", F.col("id").alias("account_id"))
    joined = changes.join(ours, ["login_id", "external_account_id"], "left")
    # a removal of a pending line that its posted line replaces on the same page needs no account
    replaced = changes.filter("pending_external_id IS NOT NULL").select("login_id", "page_no", F.col("pending_external_id").alias("external_id"), F.lit("removed").alias("op")).distinct()
    unknown = joined.filter("account_id IS NULL").join(replaced, ["login_id", "page_no", "external_id", "op"], "left_anti")
    skipped = unknown.groupBy("login_id").agg(F.count("*").alias("skipped_unknown_account"))
    return joined.filter("account_id IS NOT NULL"), skipped


def _chains(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(account_id, external_id, chain) for ids tied to another one; ids alone are their own chain."""
    ties = state.select("account_id", "external_id", "pending_external_id").unionByName(changes.select("account_id", "external_id", "pending_external_id"))
    ties = ties.filter("pending_external_id IS NOT NULL AND pending_external_id <> external_id").distinct()
    both = cut(ties.select("account_id", F.col("external_id").alias("a"), F.col("pending_external_id").alias("b")).unionByName(
        ties.select("account_id", F.col("pending_external_id").alias("a"), F.col("external_id").alias("b"))), "ties")
    label = cut(both.groupBy("account_id", "a").agg(F.min(F.least("a", "b")).alias("chain")), "chains")
    while True:
        near = both.join(label.select("account_id", F.col("a").alias("b"), "chain"), ["account_id", "b"]).groupBy("account_id", "a").agg(F.min("chain").alias("seen"))
        # and on to what the label itself is labelled with, so a chain's length doubles with every round
        beyond = label.select("account_id", F.col("a").alias("seen"), F.col("chain").alias("beyond"))
        least = F.least("chain", "seen", "beyond")
        step = cut(label.join(near, ["account_id", "a"]).join(beyond, ["account_id", "seen"], "left").select("account_id", "a", least.alias("chain"), (least < F.col("chain")).alias("moved")), "chains")
        label = step.drop("moved")
        if step.filter("moved").isEmpty():
            return label.withColumnRenamed("a", "external_id")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replay changes sorted by chain and feed order; holds the live rows of one chain at a time."""
    chain, live, page, replaced = None, {}, None, set()

    def close(out: list) -> None:
        out.extend(("row", *row) for row in live.values())

    for pdf in batches:
        out: list = []
        for c in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
            key = (c.account_id, c.chain)
            if key != chain:
                close(out)
                chain, live, page, replaced = key, {}, None, set()
            if c.page_no != page:
                page, replaced = c.page_no, set()
            fields = tuple(getattr(c, f) for f in FIELDS)
            ext = c.external_id
            if c.op == "stored":
                live[ext] = (c.id, c.account_id, ext, *fields)
                continue
            held = live.get(ext)
            if c.op == "removed":
                if ext not in replaced and held:
                    out.append(("deleted", *live.pop(ext)))
                continue
            if held:
                if c.op == "modified":
                    live[ext] = (held[0], c.account_id, ext, *fields)
                    out.append(("modified", *live[ext]))
                    if held[4] != fields[1] or held[3] != fields[0]:
                        out.append(("reset", *held))
                continue
            if any(row[8] == ext for row in live.values()):
                continue
            waiting = live.get(c.pending_external_id) if c.pending_external_id else None
            if waiting:
                del live[c.pending_external_id]
                live[ext] = (waiting[0], c.account_id, ext, *fields)
                replaced.add(c.pending_external_id)
                out.append(("resolved", *live[ext]))
                if waiting[4] != fields[1]:
                    out.append(("reset", *waiting))
                continue
            ident = "tx-" + sha256(f"{c.account_id}|{ext}|{c.page_no}|{c.pos}".encode()).hexdigest()
            live[ext] = (ident, c.account_id, ext, *fields)
            out.append((c.op, *live[ext]))
        yield pd.DataFrame(out, columns=["what", *STATE])
    out = []
    close(out)
    yield pd.DataFrame(out, columns=["what", *STATE])


def apply_feed(state: DataFrame, changes: DataFrame) -> FeedResult:
    """``state`` (stored lines) after ``changes`` (with account_id, see :func:`known_accounts`).

    ``rows``: the new lines; ``reset``: lines whose confirmed matches are
    withdrawn; ``deleted``: lines gone with all their matches; ``counts``: per
    account, changes by effect.
    """
    chains = _chains(state, changes)
    held = state.select(*STATE).withColumn("op", F.lit("stored")).withColumn("page_no", F.lit(-1).cast("bigint")).withColumn("phase", F.lit(-1)).withColumn("pos", F.lit(0))
    new = changes.select("account_id", "external_id", *FIELDS, "op", "page_no", "phase", "pos").withColumn("id", F.lit(None).cast("string"))
    lined = held.unionByName(new).join(chains, ["account_id", "external_id"], "left").withColumn("chain", F.coalesce("chain", "external_id"))
    # a removal carries no fields; plain values keep its columns free of nulls on the way to Python
    lined = lined.withColumn("amount_cents", F.coalesce("amount_cents", F.lit(0).cast("bigint"))).withColumn("pending", F.coalesce("pending", F.lit(False)))
    ordered = lined.repartition("account_id", "chain").sortWithinPartitions("account_id", "chain", "page_no", "phase", "pos", "external_id")
    out = cut(ordered.mapInPandas(_replay, _OUT), "replayed")
    rows = out.filter("what = 'row'").drop("what")
    counts = out.filter("what <> 'row'").groupBy("account_id", "what").agg(F.count("*").alias("n"))
    return FeedResult(rows, out.filter("what = 'reset'").select("id", "account_id").distinct(), out.filter("what = 'deleted'").select("id").distinct(), counts)


def withdraw_matches(matches: DataFrame, result: FeedResult) -> DataFrame:
    """Stored match rows without those of deleted lines and without the confirmed ones of changed lines."""
    gone = result.deleted.select(F.col("id").alias("transaction_id"))
    stale = result.reset.select(F.col("id").alias("transaction_id"), F.lit("manual").alias("status"))
    return matches.join(gone, "transaction_id", "left_anti").join(stale, ["transaction_id", "status"], "left_anti")


def sync_summary(result: FeedResult, matches: DataFrame) -> DataFrame:
    """One row per account: added, modified, removed, pending_resolved, matches_reset."""
    reset = result.reset.withColumnRenamed("id", "transaction_id")
    # the line may be gone by the end of the feed
    withdrawn = matches.filter("status = 'manual'").select("transaction_id").join(reset, "transaction_id").groupBy("account_id").agg(F.count("*").alias("matches_reset"))
    wide = result.counts.groupBy("account_id").pivot("what", ["added", "modified", "deleted", "resolved"]).agg(F.sum("n"))
    return wide.join(withdrawn, "account_id", "full_outer").select(
        "account_id", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in [("added", "added"), ("modified", "modified"), ("deleted", "removed"), ("resolved", "pending_resolved"), ("matches_reset", "matches_reset")]]
    )


def upsert_accounts(accounts: DataFrame, reported: DataFrame) -> DataFrame:
    """Accounts of a login: new ones added, known ones refreshed, keyed by (login, external id); ids are kept."""
    key = ["login_id", "external_account_id"]
    fields = ["name", "type", "mask"]
    ident = F.concat(F.lit("acct-"), F.sha2(F.concat_ws("|", *key), 256))
    last = reported.groupBy(*key).agg(F.max(F.struct("seq", *fields)).alias("r"))
    joined = accounts.select(*key, "id", *fields).join(last, key, "full_outer")
    return joined.select(*key, F.coalesce("id", ident).alias("id"), *[F.when(F.col("r").isNotNull(), F.col(f"r.{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def _stuck() -> Column:
    before = F.lag("cursor").over(W.partitionBy("login_id").orderBy("page_no"))
    return F.coalesce(F.col("has_more") & (F.col("cursor") == before), F.lit(False))


def page_faults(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Logins whose cursor stands still between pages or, if a number is given, with more pages than that."""
    per = pages.withColumn("stuck", _stuck()).groupBy("login_id").agg(F.max("stuck").alias("stuck"), F.count("*").alias("pages"))
    reason = F.when(F.col("stuck"), "sync cursor did not advance between pages")
    if max_pages is not None:
        reason = reason.when(F.col("pages") > max_pages, f"sync did not finish within {max_pages} pages")
    return per.withColumn("reason", reason).filter("reason IS NOT NULL").select("login_id", "pages", "reason")


def advancing(pages: DataFrame) -> DataFrame:
    """Pages of each login up to the first whose cursor stands still; that page and later ones are not folded."""
    so_far = W.partitionBy("login_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    return pages.withColumn("_stuck", _stuck()).withColumn("_stuck", F.max("_stuck").over(so_far)).filter("NOT _stuck").drop("_stuck")


def login_summary(pages: DataFrame, skipped: DataFrame, accounts: DataFrame, reported: DataFrame) -> DataFrame:
    """One row per login: accounts created and updated, pages folded, where the cursor stands, the feed's own status, changes skipped.

    ``accounts`` are those known before the sync, ``reported`` those that the
    logins named; ``skipped`` is the second result of :func:`known_accounts`.
    """
    key = ["login_id", "external_account_id"]
    known = accounts.select(*key, F.lit(True).alias("_known")).distinct()
    named = reported.select(*key).distinct().join(known, key, "left").groupBy("login_id").agg(F.count_if(F.col("_known").isNull()).alias("accounts_created"), F.count_if("_known").alias("accounts_updated"))
    folded = advancing(pages).groupBy("login_id").agg(F.count("*").alias("pages"), F.max_by("cursor", "page_no").alias("cursor"), F.max_by("update_status", "page_no").alias("update_status"))
    counted = ["accounts_created", "accounts_updated", "pages", "skipped_unknown_account"]
    return folded.join(named, "login_id", "full_outer").join(skipped, "login_id", "full_outer").select("login_id", "cursor", "update_status", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted])

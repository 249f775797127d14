"""Snapshot operators: feed, sink, queue, dictionary, decisions, quality."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from centwise.operators import dictionary, feed, quality, queue, sink
from centwise.operators.load import insert_or_ignore
from centwise.sources.feed import page_changes, read_feed
from centwise.streaming import jobs

D = dt.date


def change(op, ext, page, pos, amount=100, day=1, pending=False, pend=None):
    return {"op": op, "external_id": ext, "page_no": page, "pos": pos, "amount_cents": amount, "posted_date": D(2026, 1, day), "pending": pending, "pending_external_id": pend}


def replay(changes):
    """Plain sequential version of the feed rules for one account."""
    rows, reset, deleted, n = {}, set(), set(), 0
    for page in sorted({c["page_no"] for c in changes}):
        replaced = set()
        of = [c for c in changes if c["page_no"] == page]
        for phase in ("added", "modified", "removed"):
            for c in sorted((c for c in of if c["op"] == phase), key=lambda c: c["pos"]):
                ext = c["external_id"]
                value = (c["amount_cents"], c["posted_date"], c["pending"], c["pending_external_id"])
                if phase == "removed":
                    if ext not in replaced and ext in rows:
                        deleted.add(rows.pop(ext)[0])
                    continue
                if ext in rows:
                    if phase == "modified":
                        ident, old = rows[ext]
                        if old[:2] != value[:2]:
                            reset.add(ident)
                        rows[ext] = (ident, value)
                    continue
                if any(v[3] == ext for _, v in rows.values()):
                    continue
                pend = c["pending_external_id"]
                if pend and pend in rows:
                    ident, old = rows.pop(pend)
                    if old[0] != value[0]:
                        reset.add(ident)
                    rows[ext] = (ident, value)
                    replaced.add(pend)
                    continue
                n += 1
                rows[ext] = (n, value)
    return rows, reset, deleted


SCHEMA = "account_id string, external_id string, posted_date date, amount_cents bigint, raw_merchant string, normalized_merchant string, pending boolean, pending_external_id string, category_hint string, op string, page_no bigint, phase int, pos int"
PHASE = {"added": 0, "modified": 1, "removed": 2}


def frame(spark, by_account):
    rows = [
        (a, c["external_id"], None if c["op"] == "removed" else c["posted_date"], None if c["op"] == "removed" else c["amount_cents"], "M", "M", c["pending"], c["pending_external_id"], None, c["op"], c["page_no"], PHASE[c["op"]], c["pos"])
        for a, cs in by_account.items() for c in cs
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_feed_equals_the_walk(spark):
    rnd = random.Random(9)
    data = {}
    for a in range(40):
        cs = []
        for page in range(4):
            for pos in range(rnd.randint(1, 5)):
                op = rnd.choice(["added", "added", "added", "modified", "removed"])
                pend = f"e{rnd.randint(0, 7)}" if op != "removed" and rnd.random() < 0.4 else None
                cs.append(change(op, f"e{rnd.randint(0, 7)}", page, pos, rnd.choice([100, 200]), rnd.choice([1, 2]), rnd.random() < 0.5, pend))
        data[str(a)] = cs
    result = feed.apply_feed(spark.createDataFrame([], feed.STATE_SCHEMA), frame(spark, data))
    got = {}
    for r in result.rows.collect():
        got.setdefault(r.account_id, {})[r.external_id] = (r.amount_cents, r.posted_date, r.pending, r.pending_external_id)
    want = {a: {e: v for e, (_, v) in replay(cs)[0].items()} for a, cs in data.items()}
    assert got == {a: rows for a, rows in want.items() if rows}
    assert result.deleted.count() == sum(len(replay(cs)[2]) for cs in data.values())
    assert result.reset.count() == sum(len(replay(cs)[1]) for cs in data.values())


def test_feed_cases(spark):
    same = {"a": [change("added", "p", 0, 0, 100, pending=True), change("added", "q", 1, 0, 100, pend="p"), change("removed", "p", 1, 0)]}
    result = feed.apply_feed(spark.createDataFrame([], feed.STATE_SCHEMA), frame(spark, same))
    row = result.rows.first()
    assert (row.external_id, row.pending, result.reset.count(), result.deleted.count()) == ("q", False, 0, 0)
    # replaying the same pages on the result changes nothing
    again = feed.apply_feed(result.rows, frame(spark, same))
    assert [tuple(r) for r in again.rows.collect()] == [tuple(row)]
    more = feed.apply_feed(result.rows, frame(spark, {"a": [change("modified", "q", 2, 0, 300)]}))
    matches = spark.createDataFrame([("m1", row.id, "manual"), ("m2", row.id, "matched")], "match_id string, transaction_id string, status string")
    assert [r.match_id for r in feed.withdraw_matches(matches, more).collect()] == ["m2"]
    assert feed.sync_summary(more, matches).first().asDict() == {"account_id": "a", "added": 0, "modified": 1, "removed": 0, "pending_resolved": 0, "matches_reset": 1}


def test_feed_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(11)
    pages = []
    for page in range(9):
        side = {"added": [], "modified": [], "removed": []}
        for _ in range(6):
            ext, op = f"e{rnd.randint(0, 9)}", rnd.choice(["added", "added", "modified", "removed"])
            body = {"transaction_id": ext, "account_id": rnd.choice(["x", "y", "zz"])}
            if op != "removed":
                body |= {"amount": rnd.randint(1, 3) + 0.5, "date": "2026-01-01", "name": "Shop #1", "pending": rnd.random() < 0.5, "pending_transaction_id": f"e{rnd.randint(0, 9)}" if rnd.random() < 0.3 else None}
            side[op].append(body)
        pages.append({"login_id": "L", "page_no": page, "cursor": f"c{page}", "has_more": page < 8, **side})
    accounts = spark.createDataFrame([("L", "x", "ax"), ("L", "y", "ay")], "login_id string, external_account_id string, id string")
    (tmp_path / "pages").mkdir()
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "ck")
    for part in range(3):
        (tmp_path / "pages" / f"{part}.json").write_text("\n".join(map(json.dumps, pages[part * 3:part * 3 + 3])))
        jobs.sync_feed(spark, str(tmp_path / "pages"), accounts, log, checkpoint).awaitTermination()
    changes, skipped = feed.known_accounts(page_changes(read_feed(spark, str(tmp_path / "pages"))), accounts)
    batch = feed.apply_feed(spark.createDataFrame([], feed.STATE_SCHEMA), changes)
    assert skipped.count() == 1
    stream = sorted(map(str, jobs.feed_state(spark, log).select(*feed.STATE).collect()))
    assert stream == sorted(map(str, batch.rows.select(*feed.STATE).collect())) and stream
    stuck = spark.createDataFrame([("L", 0, "c", True), ("L", 1, "c", True)], "login_id string, page_no bigint, cursor string, has_more boolean")
    assert feed.page_faults(stuck, 200).first().reason.startswith("sync cursor did not advance")
    assert feed.page_faults(stuck.withColumn("cursor", F.col("page_no").cast("string")), 1).first().reason.startswith("sync did not finish")


def test_a_stuck_cursor_stops_its_login(spark, tmp_path):
    def page(login, no, cursor):
        body = {"transaction_id": f"t{no}", "account_id": "x", "amount": 1.0, "date": "2026-01-01", "name": "Shop", "pending": False, "pending_transaction_id": None}
        return {"login_id": login, "page_no": no, "cursor": cursor, "has_more": True, "added": [body], "modified": [], "removed": []}

    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "0.json").write_text("\n".join(map(json.dumps, [page("L", 0, "a"), page("L", 1, "a"), page("L", 2, "b"), page("M", 0, "a"), page("M", 1, "b")])))
    accounts = spark.createDataFrame([("L", "x", "ax"), ("M", "x", "mx")], "login_id string, external_account_id string, id string")
    jobs.sync_feed(spark, str(tmp_path / "pages"), accounts, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.account_id, r.external_id) for r in jobs.feed_state(spark, str(tmp_path / "log")).collect()) == [("ax", "t0"), ("mx", "t0"), ("mx", "t1")]


def test_summary_counts_lines_that_are_gone_and_no_folded_removals(spark):
    held = feed.apply_feed(spark.createDataFrame([], feed.STATE_SCHEMA), frame(spark, {"a": [change("added", "q", 0, 0, 100)]})).rows
    kept = held.first().id
    later = feed.apply_feed(held, frame(spark, {"a": [change("modified", "q", 1, 0, 300), change("removed", "q", 2, 0, None)]}))
    matches = spark.createDataFrame([("m1", kept, "manual")], "match_id string, transaction_id string, status string")
    assert later.rows.count() == 0 and feed.sync_summary(later, matches).first().matches_reset == 1
    changes = spark.createDataFrame([("L", 1, "added", "x", "posted", "wait"), ("L", 1, "removed", None, "wait", None), ("L", 1, "removed", None, "other", None)], "login_id string, page_no bigint, op string, external_account_id string, external_id string, pending_external_id string")
    accounts = spark.createDataFrame([("L", "x", "ax")], "login_id string, external_account_id string, id string")
    assert feed.known_accounts(changes, accounts)[1].first().skipped_unknown_account == 1


def test_restarted_batch_is_not_counted_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows.write.parquet(str(tmp_path / "drop"))
    table, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "drop"))
        jobs.ingest_drops(stream, ["k"], table, ck).awaitTermination()
        rows.write.mode("append").parquet(str(tmp_path / "drop"))
    # a lost checkpoint replays every file into batch 0 again
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "drop"))
    jobs.ingest_drops(stream, ["k"], table, str(tmp_path / "ck2")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == ["a", "b"]


ROW = "id string, household_id string, transaction_id string, order_item_id string, receipt_item_id string, receipt_id string, order_id string, status string, confidence bigint, method string, rationale string, credit_id string"


def row(i, tx, status, conf=50):
    return (i, "h", tx, None, None, "r", None, status, conf, "receipt_bank", "", None)


def test_sync_is_idempotent_and_spares_people(spark):
    stored = spark.createDataFrame([row("m-1", "t1", "matched"), row("m-2", "t2", "pending"), row("x-3", "t3", "manual"), row("m-4", "t4", "rejected"), row("m-5", "t5", "manual")], ROW)
    wanted = spark.createDataFrame([row("m-1", "t1", "matched", 60), row("m-4", "t4", "matched"), row("m-6", "t3", "pending"), row("m-7", "t3", "matched"), row("m-5", "t5", "matched")], ROW)
    snapshot, changes = sink.sync_matches(stored, wanted)
    assert {r.id: (r.status, r.confidence) for r in snapshot.collect()} == {
        "m-1": ("matched", 60), "x-3": ("manual", 50), "m-4": ("rejected", 50), "m-5": ("manual", 50), "m-7": ("matched", 50)}
    assert {r.id: r.op for r in changes.collect()} == {"m-1": "update", "m-2": "delete", "m-7": "insert"}
    _, second = sink.sync_matches(snapshot, wanted)
    assert {r.op for r in second.collect()} == {"keep"}


def test_items_are_zipped_by_position(spark):
    m = spark.createDataFrame([("h", "m", "t", "r", "o", "order_bank", "", None, "auto_linked", 0.5)], "household_id string, match_id string, transaction_id string, receipt_id string, order_id string, type string, rationale string, credit_id string, status string, confidence double")
    ri = spark.createDataFrame([("h", "r", f"ri{i}", i) for i in range(1, 4)], "household_id string, receipt_id string, id string, line_no bigint")
    oi = spark.createDataFrame([("h", "o", "oi1", "s", 1, False), ("h", "o", "oi2", "s", 2, True)], "household_id string, order_id string, id string, shipment_id string, item_seq bigint, is_return boolean")
    assert sorted(r.id for r in sink.expand_matches(m, ri, oi).collect()) == ["m-m-oi1-ri1", "m-m-x-ri2", "m-m-x-ri3"]
    assert [r.id for r in sink.expand_matches(m.withColumn("status", F.lit("review")), ri, oi).collect()] == ["m-m"]


def test_learned_store_names(spark):
    slips = spark.createDataFrame([("h", "New Seasons Market #12"), ("h", "Zupan's"), ("g", "Nowhere Deli")], "household_id string, store string")
    lines = spark.createDataFrame([("h", m) for m in ["NEW SEASONS MARKET PORTLAND", "NEW SEASONS", "PDX NEW SEASONS MARKET", "NEW", "NOWHERE DELI", "COSTCO WHSE", "ZUPAN S 12", "NEW SEASONS MARKET GAS"]], "household_id string, normalized_merchant string")
    got = {r.normalized_merchant: r.merchant for r in queue.receipt_merchants(lines, slips).collect()}
    assert got == {"NEW SEASONS MARKET PORTLAND": "New Seasons Market", "NEW SEASONS": "New Seasons", "PDX NEW SEASONS MARKET": "New Seasons Market", "COSTCO WHSE": "Costco", "ZUPAN S 12": "Zupan's"}


DICT = "household_id string, store string, sku_or_abbrev string, canonical_name string, category string, name_confidence double, category_confidence double, source string, updated_at bigint"


def entry(store, sku, name, source, at):
    return ("h", store, sku, name, "other", 1.0, 1.0, source, at)


def test_dictionary_precedence(spark):
    held = spark.createDataFrame([entry("COSTCO", "1", "auto old", "auto", 1), entry("COSTCO", "2", "person", "human", 1)], DICT)
    new = spark.createDataFrame(
        [(*entry("Costco Whse", "1", "auto new", "auto", 2), 1), (*entry("COSTCO", "2", "auto new", "auto", 2), 2), (*entry("COSTCO", "3", "first", "auto", 2), 3), (*entry("COSTCO", "3", "second", "auto", 2), 4),
         (*entry("COSTCO", "4", "h1", "human", 2), 5), (*entry("COSTCO", "4", "h2", "human", 2), 6), (*entry("COSTCO", "1", "said", "human", 3), 7)], DICT + ", seq int")
    assert {r.sku_or_abbrev: r.canonical_name for r in dictionary.upsert(held, new).collect()} == {"1": "said", "2": "person", "3": "first", "4": "h2"}
    odd = spark.createDataFrame([entry("Costco #1", "a*b", "new auto", "auto", 9), entry("COSTCO", "A B", "old person", "human", 1), entry(" ", "x", "kept", "auto", 1)], DICT)
    assert {(r.store, r.sku_or_abbrev): r.canonical_name for r in dictionary.rekey(odd).collect()} == {("COSTCO", "A B"): "old person", (" ", "x"): "kept"}


def brute_pairs(actual, expected, score):
    claimed, out = set(), []
    for e_idx, e_sku, e_name in expected:
        free = [a for a in actual if a[0] not in claimed]
        hit = next((a for a in free if e_sku and a[1] is not None and a[1].lstrip("0") == e_sku.lstrip("0")), None)
        best = hit or (max(free, key=lambda a: (score(a[2], e_name), -a[0])) if free else None)
        if best:
            claimed.add(best[0])
        out.append((e_idx, best[0] if best else None))
    return out


def test_pairing_equals_the_walk(spark):
    from tests.test_functions import brute_dice

    rnd = random.Random(12)
    acts, exps, want = [], [], []
    for r in range(40):
        def side():
            return [(i, rnd.choice([None, "7", "08", "9"]), rnd.choice(["abcd", "abce", "xbcd", "qq", "zzz"])) for i in range(rnd.randint(1, 5))]

        a, e = side(), side()
        acts += [("h", str(r), i, s, n, None) for i, s, n in a]
        exps += [("h", str(r), i, s, n, None) for i, s, n in e]
        want += [(str(r), *p) for p in brute_pairs(a, e, brute_dice)]
    schema = "household_id string, receipt_id string, idx bigint, sku string, name string, category string"
    pairs = quality.pair_items(spark.createDataFrame(acts, schema), spark.createDataFrame(exps, schema))
    assert sorted((r.receipt_id, r.e_idx, -1 if r.a_idx is None else r.a_idx) for r in pairs.collect()) == sorted((r, e, -1 if a is None else a) for r, e, a in want)


def test_pairing_groups_a_receipt_once_and_compares_names_only_where_needed(spark):
    """Names of the same letters pairs score 1 as well, so the earlier of them wins; lines without a receipt stay alone."""
    schema = "household_id string, receipt_id string, idx bigint, sku string, name string, category string"
    acts = spark.createDataFrame([("h", "r", 1, None, "xbxax", None), ("h", "r", 2, None, "xaxbx", None), ("h", "r", 3, "007", "other", None), ("h", None, 4, "7", "lost", None)], schema)
    exps = spark.createDataFrame([("h", "r", 1, None, "XAXBX", None), ("h", "r", 2, "7", "xaxbx", None), ("h", "r", 3, None, None, None), ("h", "r", 4, None, "none left", None), ("h", None, 5, "7", "lost", None)], schema)
    pairs = quality.pair_items(acts, exps)
    assert sorted((r.e_idx, r.a_idx, r.score) for r in pairs.collect()) == [(1, 1, 1.0), (2, 3, 0.0), (3, 2, None), (4, None, None), (5, None, None)]
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,limit", [(10, 3), (97, 10), (5, 9), (100, 100), (1000, 7), (10, 0), (10, None)])
def test_even_sampling(spark, n, limit):
    rows = spark.range(n).select(F.format_string("%05d", "id").alias("id"))
    want = list(range(n)) if limit is None or limit >= n else [int(i * (n / limit)) for i in range(limit)]
    assert sorted(int(r.id) for r in quality.sample_evenly(rows, ["id"], limit).collect()) == want


def test_first_row_by_file_and_place(spark, tmp_path):
    """The smaller file comes first by name; Spark reads the larger one first."""
    small = [(i, "small", n) for n, i in enumerate([5, 3, 5, 9])]
    large = [(i % 4000, "large", i) for i in range(60_000)]
    for name, rows in (("a", small), ("b", large)):
        spark.createDataFrame(rows, "k int, file string, n int").coalesce(1).write.parquet(str(tmp_path / name))
    batch = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    stored = spark.createDataFrame([(9,)], "k int")
    got = {r.k: (r.file, r.n) for r in insert_or_ignore(stored, batch, ["k"]).collect()}
    assert got == {i: ("large", i) for i in range(4000) if i != 9} | {5: ("small", 0), 3: ("small", 1)}


def folders_read(df):
    """(batch or snapshot folder, bucket folder) of the files that a frame scans."""
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert all("bucket" in s.split("PartitionFilters: [", 1)[1].split("]")[0] for s in scans)  # pruned before they are opened
    return {tuple(r.f.split("/")[-3:-1]) for r in df.select(F.input_file_name().alias("f")).distinct().collect() if r.f}


def test_a_batch_reads_the_folders_of_its_keys(spark, tmp_path):
    from centwise.streaming.keyed import KeyedLog, bucket, buckets_of

    rnd = random.Random(5)
    newest = lambda rows: rows.groupBy("k").agg(F.max(F.struct("version", "v")).alias("m")).select("k", "m.v", "m.version")
    log = KeyedLog(spark, str(tmp_path / "log"), "k string, v int", ["k"], newest, buckets=8, every=3)
    held = {}
    for batch in range(8):
        rows = [(f"k{rnd.randint(0, 30)}", 100 * batch + i) for i in range(12)]
        rows = list({k: (k, v) for k, v in rows}.values())
        df = spark.createDataFrame(rows, "k string, v int")
        before = log.before(batch, df)
        wanted = {f"bucket={r.bucket}" for r in df.select(bucket(["k"], 8)).collect()}
        named = {k for k, _ in rows}
        assert {r.k: r.v for r in before.filter(F.col("k").isin(list(named))).collect()} == {k: v for k, v in held.items() if k in named}
        if batch:
            one = spark.createDataFrame(rows[:1], df.schema)
            parts = folders_read(log._rows(log._folders(batch), buckets_of(one, ["k"], 8)))
            assert {b for _, b in parts} <= {f"bucket={buckets_of(one, ['k'], 8)[0]}"} and {f for f, _ in parts} <= {f.rsplit("/", 1)[-1] for f in log._folders(batch)} and len(log._folders(batch)) <= 3
            assert {b for _, b in folders_read(log._rows(log._folders(batch), buckets_of(df, ["k"], 8)))} <= wanted
        if batch % 2:  # a batch that is run again replaces what it wrote
            log.write(spark.createDataFrame([("gone", 1)], df.schema), batch)
        log.write(df, batch)
        held |= dict(rows)
    assert sorted(p.name for p in (tmp_path / "log-snapshots").iterdir()) == ["upto=2", "upto=5"]


def test_rederivation_reads_the_folders_of_touched_households(spark, tmp_path):
    facts = spark.createDataFrame([(f"h{i}", i) for i in range(200)], "household_id string, n int")
    schemas = jobs.store_tables({"bank": facts}, str(tmp_path / "t"))
    changed = spark.createDataFrame([("h7",), ("h9",), ("h9",)], "household_id string")
    got = jobs.touched_tables(spark, str(tmp_path / "t"), schemas, changed)["bank"]
    assert len({b for _, b in folders_read(got)}) <= 2 and {"h7", "h9"} <= {r.household_id for r in got.collect()}
    assert got.columns == ["household_id", "n"]


def test_feed_stream_across_snapshots(spark, tmp_path, monkeypatch):
    """Twelve batches of one page, a snapshot after every second one: as all pages at once."""
    monkeypatch.setattr(jobs, "feed_log", lambda spark, path: jobs.KeyedLog(spark, path, jobs._LOG, ["account_id"], jobs.current_rows, every=2))
    rnd = random.Random(12)
    pages = []
    for page in range(12):
        side = {"added": [], "modified": [], "removed": []}
        for _ in range(5):
            ext, op = f"e{rnd.randint(0, 7)}", rnd.choice(["added", "modified", "removed"])
            body = {"transaction_id": ext, "account_id": rnd.choice(["x", "y"])}
            if op != "removed":
                body |= {"amount": rnd.randint(1, 3) + 0.5, "date": "2026-01-01", "name": "Shop", "pending": False, "pending_transaction_id": f"e{rnd.randint(0, 7)}" if rnd.random() < 0.3 else None}
            side[op].append(body)
        pages.append({"login_id": "L", "page_no": page, "cursor": f"c{page}", "has_more": page < 11, **side})
    accounts = spark.createDataFrame([("L", "x", "ax"), ("L", "y", "ay")], "login_id string, external_account_id string, id string")
    (tmp_path / "pages").mkdir()
    for i, page in enumerate(pages):  # files are taken by their time
        (tmp_path / "pages" / f"{i:02d}.json").write_text(json.dumps(page))
        os.utime(tmp_path / "pages" / f"{i:02d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    jobs.sync_feed(spark, str(tmp_path / "pages"), accounts, str(tmp_path / "log"), str(tmp_path / "ck"), files_per_trigger=1).awaitTermination()
    batch = feed.apply_feed(spark.createDataFrame([], feed.STATE_SCHEMA), feed.known_accounts(page_changes(read_feed(spark, str(tmp_path / "pages"))), accounts)[0])
    want = sorted(map(str, batch.rows.select(*feed.STATE).collect()))
    assert sorted(map(str, jobs.feed_state(spark, str(tmp_path / "log")).collect())) == want and want


def test_open_keys_equals_the_work_list_of_resolved_items(spark):
    """Keys alone, in one grouping: no join, and no names carried along to be thrown away."""
    none = None
    items = spark.createDataFrame([
        ("h", "Costco Whse 118", "s1", "A"), ("h", "COSTCO", "S1", "A"), ("h", "COSTCO", none, "ks*evoo  2l"), ("h", "ACME", "S3", "A"), ("h", "", "S4", "A"), ("h", "", "S5", "A"), ("h", none, "S6", "A"),
        ("h", "COSTCO", none, none), (none, "COSTCO", "S1", "A"), ("g", "COSTCO", "S1", "A"), ("h", "  ", "S7", "A"), ("h", "WALMART #12", "S8", "A"), ("h", "WALMART", "s8", "A"),
    ], "household_id string, store string, sku string, raw_description string")
    held = [("h", "costco 12", "s*1", "auto"), ("h", "COSTCO WHSE", "S*1", "human"), ("h", "", "S4", "auto"), ("h", " ", "S5", "auto"), ("h", none, "S6", "auto"), (none, "COSTCO", "S1", "auto"), ("h", "COSTCO", none, "auto")]
    entries = spark.createDataFrame([(h, s, k, "n", "c", 0.9, 0.9, source, 1) for h, s, k, source in held], "household_id string, store string, sku_or_abbrev string, canonical_name string, category string, name_confidence double, category_confidence double, source string, updated_at bigint")
    answers = spark.createDataFrame([("h", "ACME", "S3", "n", "zebra", 0.9, 0.9), ("h", none, "S6", "n", "other", 0.9, 0.9)], "household_id string, store string, sku_or_abbrev string, canonical_name string, category string, name_confidence double, category_confidence double")
    want = dictionary.work_list(dictionary.resolve_items(items, dictionary.rekey(entries), answers))
    got = dictionary.open_keys(items, entries, answers)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and ("h", "COSTCO", "S 1") not in {tuple(r) for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan

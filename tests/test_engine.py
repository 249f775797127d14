"""Matching and ledger against a hand-worked household and small sequential versions."""

import datetime as dt
import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from centwise.config import ReconcileConfig
from centwise.functions import text
from centwise.operators import assign, candidates, cells, corrections, merge, names, recurring, refunds, rollup, split
from centwise.operators.matching import apply_decisions, match_record, match_receipts
from centwise.plans import reconcile as engine
from centwise.sources.tables import Inputs

H = "hh"
BANK = "household_id string, id string, account_id string, posted_date date, amount_cents bigint, direction string, normalized_merchant string"
ORDERS = "household_id string, id string, external_order_id string, order_date date, order_total_cents bigint"
OITEMS = "household_id string, id string, order_id string, shipment_id string, item_seq bigint, description string, amount_cents bigint, is_return boolean, refund_destination string"
RECEIPTS = "household_id string, id string, store string, purchased_at date, total_cents bigint, payment_last4 string"
RITEMS = "household_id string, id string, receipt_id string, line_no bigint, raw_description string, canonical_name string, line_price_cents bigint, discount_cents bigint"
CREDIT = "id string, household_id string, kind string, amount_cents bigint, occurred_on date, order_id string, order_item_id string"
SAID = "household_id string, transaction_id string, receipt_id string, order_id string"


def day(s):
    return dt.date.fromisoformat(s)


def bank(spark, rows):
    return spark.createDataFrame([(H, i, "a", day(p), c, "debit" if c < 0 else "credit", m) for i, p, c, m in rows], BANK)


def household(spark, lines=(), orders=(), oitems=(), receipts=(), ritems=(), credit=(), said=()):
    return Inputs(
        bank(spark, lines), spark.createDataFrame([(H, *o) for o in orders], ORDERS), spark.createDataFrame([(H, *o) for o in oitems], OITEMS),
        spark.createDataFrame([(H, *r) for r in receipts], RECEIPTS), spark.createDataFrame([(H, *r) for r in ritems], RITEMS),
        spark.createDataFrame(list(credit), CREDIT), spark.createDataFrame([(H, *s) for s in said], SAID),
    )


@pytest.fixture(scope="module")
def golden(spark):
    inputs = household(
        spark,
        lines=[
            ("b1", "2024-01-15", -4999, "WHOLE FOODS"), ("b2", "2024-01-20", -1200, "PARKING"), ("b3", "2024-02-02", -999, "NETFLIX"), ("b4", "2024-03-01", 1600, "AMAZON"),
            ("b5", "2024-03-10", -8500, "OLD NAVY"), ("b7", "2024-04-05", -5400, "TRADER JOES"), ("b8", "2024-01-23", -4298, "AMAZON"), ("b9", "2024-03-21", -4000, "AMAZON"), ("b10", "2024-03-22", -3000, "AMAZON"),
            ("b11", "2024-05-02", -2000, "SAFEWAY"),
        ],
        orders=[("o1", "111", day("2024-01-20"), 4298), ("o2", "112", day("2024-02-10"), 0), ("o5", "115", day("2024-03-20"), 7000), ("o6", "116", day("2024-06-20"), 777)],
        oitems=[
            ("i1", "o1", "s", 1, "usb-c cable", 2298, False, None), ("i2", "o1", "s", 2, "paperback", 2000, False, None), ("i3", "o2", "s", 1, "shirt", 2400, False, None),
            ("i4", "o2", "s", 2, "shirt", -2400, True, "gift_card"), ("i5", "o5", "s", 1, "keyboard", 7000, False, None), ("i6", "o6", "s", 1, "novel", 777, False, None),
        ],
        receipts=[
            ("r1", "Whole Foods", day("2024-01-15"), 4999, None), ("r2", "Corner Shop", day("2024-02-20"), 777, None), ("r3", "Old Navy", day("2024-03-10"), 8500, None),
            ("r4", "Trader Joes", day("2024-04-05"), 5400, None), ("r5", "Safeway", day("2024-05-02"), 4100, None),
        ],
        ritems=[("x1", "r1", 1, "whole foods apples", None, 4999, 0), ("x3", "r3", 1, "SHIRT", "Shirt", 8500, 0), ("x4", "r4", 1, "BREAD", "Bread", 5400, 0)],
        credit=[("c1", H, "gift_card", 2400, day("2024-02-10"), "o2", "i4")],
    )
    ledger = engine.written(engine.reconcile(inputs))
    return inputs, ledger


def test_golden_events(golden):
    inputs, ledger = golden
    got = {r.event_id: (r.signed_spend_cents, str(r.occurred_on)[:7]) for r in ledger.events.collect()}
    assert got == {
        "led-bank-b1": (4999, "2024-01"), "led-bank-b8": (4298, "2024-01"), "led-split-b10+b9": (7000, "2024-03"), "led-bank-b5": (8500, "2024-03"), "led-bank-b7": (5400, "2024-04"),
        "refund-card-b4": (-1600, "2024-03"), "refund-sc-o2-i4": (-2400, "2024-02"), "sc-partial-b11-r5": (4100, "2024-05"),
    }


def test_golden_matches(golden):
    _, ledger = golden
    got = {r.match_id: (r.confidence, r.status, r.credit_id) for r in ledger.matches.collect()}
    assert got["receipt_bank-r1-b1"][0] == pytest.approx(0.95)
    assert got["order_bank-o1-b8"][0] == pytest.approx(0.6 + 0.4 * (1 - 3 / 7))
    assert got["order_bank_split-o5-b10+b9"][0] == pytest.approx(0.85 * (1 - 2 / 7) + 0.15)
    assert got["store_credit_refund-o2-i4"] == (0.95, "auto_linked", "c1")
    assert got["store_credit_drawdown-b11-r5"][1:] == ("auto_linked", "c1")
    assert [tuple(r) for r in ledger.drawdowns.select("kind", "amount_cents").collect()] == [("gift_card", -2100)]


def test_golden_rollup_and_invariants(golden):
    inputs, ledger = golden
    cells = rollup.event_cells(ledger.events, ledger.items)
    table = {(r.category, r.month): r.net_spend_cents for r in rollup.ledger_rollup(cells).collect()}
    assert table[("Groceries", "2024-01")] == 4999 and table[("Electronics", "2024-03")] == 7000 and table[("Clothing", "2024-03")] == 8500
    assert table[("uncategorized", "2024-03")] == -1600
    net = rollup.net_spend(ledger.events).first().net_spend_cents
    assert sum(table.values()) == net == 30297
    assert cells.count() == cells.select("event_id").distinct().count() == ledger.events.count()
    left = {(r.kind, r.id) for r in engine.unmatched(inputs, ledger).collect()}
    assert left == {("bank_line", "b2"), ("bank_line", "b3"), ("receipt", "r2"), ("order_item", "i6")}
    summary = engine.run_summary(inputs, ledger).first()
    assert (summary.bank_lines, summary.review, summary.unmatched_receipts, summary.net_spend_cents) == (10, 0, 1, net)


def test_rerun_gives_the_same_ledger(golden):
    inputs, ledger = golden
    again = engine.reconcile(inputs)
    assert sorted(map(tuple, again.events.collect()), key=str) == sorted(map(tuple, ledger.events.collect()), key=str)


def test_corrections(spark, golden):
    _, ledger = golden
    out = corrections.apply_corrections(ledger, [
        {"kind": "reclassify_item", "household_id": H, "receipt_item_id": "x1", "new_category": "Dining"},
        {"kind": "relink_match", "household_id": H, "match_id": "receipt_bank-r3-b5", "new_transaction_id": "b7"},
        {"kind": "reject_match", "household_id": H, "match_id": "order_bank-o1-b8"},
        {"kind": "reject_match", "household_id": H, "match_id": "no-such"},
    ])
    events = {r.event_id: (r.transaction_id, str(r.occurred_on)) for r in out.events.collect()}
    assert events["led-bank-b5"] == ("b7", "2024-04-05") and events["led-bank-b7"] == ("b5", "2024-03-10") and "led-bank-b8" not in events
    assert {r.receipt_item_id: r.category for r in out.items.collect() if r.receipt_item_id}["x1"] == "Dining"
    with pytest.raises(ValueError):
        corrections.apply_corrections(ledger, [{"kind": "other"}])


def test_relinks_in_order_equal_one_at_a_time(spark):
    """A list of moves composed at once against plain steps; the plan doesn't grow with the list."""
    rnd = random.Random(8)
    matches, events, moves = [], [], []
    for hh in ("h1", "h2", "h3"):
        lines = [f"{hh}t{i}" for i in range(7)]
        matches += [(hh, f"{hh}m{i}", rnd.choice([*lines[:5], None])) for i in range(5)]
        events += [(hh, f"{hh}e{i:02d}", rnd.choice([*lines[:6], None]), day(f"2024-01-{i + 1:02d}")) for i in range(9)]
        moves += [(hh, i, rnd.choice([f"{hh}m{k}" for k in range(5)] + ["no-such"]), rnd.choice(lines)) for i in range(25)]
    tx = {(h, m): t for h, m, t in matches}
    at = {(h, e): [t, d] for h, e, t, d in events}
    for h, _, m, new in sorted(moves, key=lambda x: x[1]):
        old = tx.get((h, m))
        if (h, m) in tx:
            tx[h, m] = new
        here, there = (min((e for (g, e), v in at.items() if g == h and t is not None and v[0] == t), default=None) for t in (old, new))
        if here is None or here == there:
            continue
        at[h, here][0] = new
        if there is not None:
            at[h, there][0] = old
            at[h, here][1], at[h, there][1] = at[h, there][1], at[h, here][1]
    made = match_record(spark.createDataFrame(matches, "household_id string, match_id string, transaction_id string"))
    ledger = engine.Ledger(spark.createDataFrame(events, "household_id string, event_id string, transaction_id string, occurred_on date"), spark.range(0), made, spark.range(0))
    frame = spark.createDataFrame(moves, "household_id string, seq int, match_id string, new_transaction_id string")
    out = corrections.relink_in_order(ledger, frame)
    assert {(r.household_id, r.event_id): [r.transaction_id, r.occurred_on] for r in out.events.collect()} == at
    assert {(r.household_id, r.match_id): r.transaction_id for r in out.matches.collect()} == tx

    def joins(n):
        edits = [{"kind": "relink_match", "household_id": h, "match_id": m, "new_transaction_id": t} for h, _, m, t in (moves * 3)[:n]]
        return corrections.apply_corrections(ledger, edits).events._jdf.queryExecution().analyzed().toString().count("Join")

    assert joins(1) == joins(200)


def greedy(edges):
    left, right, out = set(), set(), []
    for rank, a, b in sorted(edges):
        if a not in left and b not in right:
            left.add(a), right.add(b), out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_sequential_greedy(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], []
    for hh in range(30):
        n = rnd.randint(1, 6)
        edges = [(rnd.randint(0, 3), f"{hh}l{i}", f"{hh}r{j}") for i in range(n) for j in range(n) if rnd.random() < 0.6]
        rows += [(str(hh), *e) for e in edges]
        want += greedy(edges)
    df = spark.createDataFrame(rows, "household_id string, k int, l string, r string")
    got = assign.greedy_pairs(df, "l", "r", [F.col("k"), F.col("l"), F.col("r")])
    assert sorted((r.l, r.r) for r in got.collect()) == sorted(want)


def test_sets_equal_sequential_greedy(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for hh in range(40):
        used, cands = set(), []
        for o in range(rnd.randint(1, 7)):
            cands.append((rnd.randint(0, 2), f"{hh}o{o}", [f"{hh}t{x}" for x in sorted(rnd.sample(range(6), rnd.randint(1, 3)))]))
        rows += [(str(hh), *c) for c in cands]
        for k, o, m in sorted(cands):
            if not used & set(m):
                used |= set(m)
                want.append(o)
    df = spark.createDataFrame(rows, "household_id string, k int, o string, m array<string>")
    assert sorted(r.o for r in assign.greedy_sets(df, "o", "m", [F.col("k"), F.col("o")]).collect()) == sorted(want)


def first_subset(amounts, target):
    def walk(start, left, chosen):
        if left == 0:
            return chosen
        for i in range(start, len(amounts)):
            if amounts[i] <= left:
                found = walk(i + 1, left - amounts[i], [*chosen, i])
                if found is not None:
                    return found
        return None

    return walk(0, target, []) or []


def test_first_subset_equals_depth_first(spark):
    rnd = random.Random(1)
    cases = [([rnd.randint(1, 9) for _ in range(rnd.randint(2, 9))], rnd.randint(5, 30)) for _ in range(300)]
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(cases)], "i int, a array<bigint>, t bigint")
    got = [r[0] for r in df.orderBy("i").select(split.first_exact_subset(F.col("a"), F.col("t"))).collect()]
    assert got == [first_subset(a, t) for a, t in cases]


def test_subsets_across_words_of_the_bit_set(spark):
    rnd = random.Random(11)
    cases = [([rnd.choice([1, 63, 64, 65, 127, 128, 129, 500]) for _ in range(rnd.randint(2, 8))], rnd.choice([64, 127, 128, 192, 255, 256, 700])) for _ in range(200)]
    cases.append(([30_000 + 7 * i for i in range(40)], 30_000 + 31_001 + 6))
    cases.append(([37_501] * 39 + [37_461], 1_500_000))
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(cases)], "i int, a array<bigint>, t bigint")
    got = [r[0] for r in df.orderBy("i").select(split.first_exact_subset(F.col("a"), F.col("t"))).collect()]
    assert got[:-2] == [first_subset(a, t) for a, t in cases[:-2]]
    assert got[-2] == [] and got[-1] == list(range(40))


def test_a_pool_of_any_size_is_searched(spark):
    orders = spark.createDataFrame([(H, "o", "x", day("2024-01-10"), 30_011)], ORDERS)
    lines = bank(spark, [("a", "2024-01-10", -10_000, "AMAZON"), ("b", "2024-01-11", -20_011, "AMAZON")] + [(f"c{i}", "2024-01-12", -2 * (900 + i), "AMAZON") for i in range(38)] + [(f"z{i}", "2024-01-12", -90_000 - i, "AMAZON") for i in range(30)])
    direct = candidates.order_direct(lines, orders, ReconcileConfig(tip_tolerance_cents=0))
    found = split.order_split(lines, orders, direct).collect()
    assert len(found) == 1 and sum({r.transaction_id: r.bank_cents for r in candidates.retailer_debits(lines).collect()}[t] for t in found[0].transaction_ids) == 30_011


def test_name_join_equals_all_pairs(spark):
    from centwise.functions.similarity import dice_of_comparable

    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 9))).strip() for _ in range(120)]
    a = spark.createDataFrame([(H, w) for w in set(words[:70])], "household_id string, left_name string")
    b = spark.createDataFrame([(H, w) for w in set(words[40:])], "household_id string, right_name string")
    for cutoff in (0.5, 0.72, 1.0):
        all_pairs = a.join(b, "household_id").filter(dice_of_comparable(F.col("left_name"), F.col("right_name")) >= cutoff)
        want = {(r.left_name, r.right_name) for r in all_pairs.collect()}
        assert {(r.left_name, r.right_name) for r in names.similar_names(a, b, cutoff).collect()} == want


def test_refund_receipt_may_match_a_small_debit(spark):
    lines = bank(spark, [("b", "2024-01-10", -500, "COSTCO")])
    slips = spark.createDataFrame([(H, "r", "COSTCO", day("2024-01-10"), -400, None), (H, "z", "COSTCO", day("2024-01-10"), 0, None)], RECEIPTS)
    assert [r.receipt_id for r in match_receipts(lines, slips).collect()] == ["r"]


def test_human_decisions(spark):
    m = spark.createDataFrame(
        [(H, "m1", "receipt_bank", "t1", None, "r1", 0.6, "review"), (H, "m2", "receipt_bank", "t2", None, "r9", 0.9, "auto_linked"), (H, "m3", "order_bank", "t3", "o3", None, 0.9, "auto_linked"),
         (H, "m4", "order_bank", "t4", "o5", None, 0.9, "auto_linked")],
        "household_id string, match_id string, type string, transaction_id string, order_id string, receipt_id string, confidence double, status string")
    said = spark.createDataFrame([(H, "t1", "r1", None), (H, "t3", None, "o4"), (H, "t7", "r9", None), (H, "t8", None, None)], SAID)
    got = {r.match_id: (r.status, r.confidence, r.confirmed_by) for r in apply_decisions(match_record(m), said).collect()}
    assert got == {
        "m1": ("auto_linked", 1.0, "human"), "m4": ("auto_linked", 0.9, None), "order_bank-o4-t3": ("auto_linked", 1.0, "human"), "receipt_bank-r9-t7": ("auto_linked", 1.0, "human")}


def test_credit_row_anchors_only_without_a_bank_line(spark):
    rows = [(H, "d1", "store_credit_drawdown", None, None, "r1", "c1"), (H, "d2", "store_credit_drawdown", None, "o2", "r2", "c2"), (H, "d3", "order_bank", "b1", "o2", None, None)]
    m = match_record(spark.createDataFrame(rows, "household_id string, match_id string, type string, transaction_id string, order_id string, receipt_id string, credit_id string"))
    credit = spark.createDataFrame([("c1", H, "gift_card", 700, day("2024-01-01"), "o1", None), ("c2", H, "gift_card", 800, day("2024-01-01"), "o2", None)], CREDIT)
    events, _ = merge.merge_counted(m, bank(spark, [("b1", "2024-01-02", -800, "AMAZON")]), spark.createDataFrame([], ORDERS), credit)
    assert {(r.event_id, r.signed_spend_cents, r.order_id) for r in events.collect()} == {("led-sc-c1", 700, "o1"), ("led-bank-b1", 800, "o2")}


def test_split_with_a_missing_line_makes_no_event(spark):
    rows = [(H, "s", "order_bank_split", "b1", ["b1", "b2"], "o")]
    m = match_record(spark.createDataFrame(rows, "household_id string, match_id string, type string, transaction_id string, transaction_ids array<string>, order_id string"))
    events, _ = merge.merge_counted(m, bank(spark, [("b1", "2024-01-02", -800, "AMAZON")]), spark.createDataFrame([], ORDERS), spark.createDataFrame([], CREDIT))
    assert events.count() == 0


def test_credit_is_spent_in_order(spark):
    pairs = [(H, f"t{i}", f"r{i}", gap, conf) for i, (gap, conf) in enumerate([(50, 0.9), (70, 0.8), (60, 0.7), (10, 0.6), (500, 0.5)])]
    df = spark.createDataFrame(pairs, "household_id string, transaction_id string, receipt_id string, gap_cents bigint, confidence double")
    credit = spark.createDataFrame([("a", H, "gift_card", 100, None, None, None), ("b", H, "store_credit", 65, None, None, None), ("c", H, "account_balance", 5, None, None, None)], CREDIT)
    got = {r.transaction_id: r.kind for r in refunds.spend_credit(df, credit).collect()}
    assert got == {"t0": "gift_card", "t1": None, "t2": "store_credit", "t3": "gift_card", "t4": None}


def test_credit_equals_a_walk(spark):
    rnd = random.Random(6)
    pairs, credit, want = [], [], {}
    kinds = ["gift_card", "store_credit", "account_balance"]
    for hh in range(25):
        left = {}
        for k in kinds:
            if rnd.random() < 0.8:
                left[k] = rnd.choice([-50, 0, 120, 400, 2000])
                credit.append((f"{hh}{k}", str(hh), k, left[k], None, None, None))
        own = [(f"t{i}", f"r{i}", rnd.choice([1, 30, 60, 99, 100, 119, 400]), rnd.choice([0.5, 0.7, 0.9])) for i in range(rnd.choice([0, 3, 40]))]
        pairs += [(str(hh), *x) for x in own]
        for t, r, gap, _ in sorted(own, key=lambda x: (-x[3], x[0], x[1])):
            kind = next((k for k in kinds if left.get(k, 0) >= gap), None)
            if kind:
                left[kind] -= gap
            want[str(hh), t] = kind
    df = spark.createDataFrame(pairs, "household_id string, transaction_id string, receipt_id string, gap_cents bigint, confidence double")
    got = {(r.household_id, r.transaction_id): r.kind for r in refunds.spend_credit(df, spark.createDataFrame(credit, CREDIT)).collect()}
    assert got == want and len({k for k in want.values()}) == 4


def test_anchor_groups_equal_a_fold(spark):
    rnd = random.Random(3)
    amounts = {m: sorted({rnd.randint(0, 4000) for _ in range(60)}) for m in "abc"}
    df = spark.createDataFrame([(H, m, a) for m, xs in amounts.items() for a in xs], "household_id string, merchant string, signed_spend_cents bigint")
    chain = [(H, "d", 201 * i) for i in range(300)] + [(H, "e", -5), (H, "e", 195), (H, "e", 196), (H, "e", -206)]
    amounts |= {"d": [201 * i for i in range(300)], "e": [-206, -5, 195, 196]}
    df = df.union(spark.createDataFrame(chain, df.schema))
    got = {(r.merchant, r.signed_spend_cents): r.anchor for r in recurring.amount_anchors(df, 200).collect()}
    want = {}
    for m, xs in amounts.items():
        anchor = None
        for x in xs:
            anchor = x if anchor is None or x - anchor > 200 else anchor
            want[(m, x)] = anchor
    assert got == want


def test_one_huge_household_is_not_special(spark):
    """A household with most of the rows goes through the same plan; the result equals the walk."""
    rnd = random.Random(7)
    lines = [(f"b{i:04d}", f"2024-01-{rnd.randint(1, 28):02d}", -rnd.randint(100, 9000), rnd.choice(["COSTCO", "TARGET", "WALMART"])) for i in range(400)]
    slips = [(H, f"r{i:04d}", rnd.choice(["COSTCO", "TARGET", "WALMART"]), day(f"2024-01-{rnd.randint(1, 28):02d}"), rnd.randint(100, 9000), None) for i in range(300)]
    edges = []
    for i, p, c, m in lines:
        for _, r, s, d, t, _4 in slips:
            days, diff = abs((day(p) - d).days), abs(t - -c)
            if m == s and days <= 3 and diff <= 1500:
                conf = 1.0 * 0.4 + (1.0 - diff / 1500.0) * 0.3 + (1.0 - days / 3.0) * 0.2 + 0.5 * 0.1
                edges.append(((-conf, r, i), r, i))
    got = match_receipts(bank(spark, lines), spark.createDataFrame(slips, RECEIPTS))
    assert sorted((r.receipt_id, r.transaction_id) for r in got.collect()) == greedy(edges)


def block_edges(seed, households=12):
    """Edges between blocks of random sizes, whose members' ids are mixed among the blocks, with few different ranks."""
    rnd = random.Random(seed)
    edges, lefts, rights, pairs = [], [], [], []
    for hh in range(households):
        sides = []
        for side, rows in (("l", lefts), ("r", rights)):
            names = [f"{hh}{side}{i:03d}" for i in range(rnd.randint(2, 14))]
            rnd.shuffle(names)
            own = []
            while names:
                n = rnd.choice([1, 1, 2, 3, 7])
                own.append(sorted(names[:n]))
                names = names[n:]
                if len(own[-1]) > 1:
                    rows += [(str(hh), own[-1][0], x, at) for at, x in enumerate(own[-1])]
            sides.append(own)
        for a in sides[0]:
            for b in sides[1]:
                if rnd.random() < 0.6:
                    rank = rnd.randint(0, 2)
                    edges.append((str(hh), rank, a[0], b[0], len(a), len(b)))
                    pairs += [(rank, x, y) for x in a for y in b]
    return edges, lefts, rights, pairs


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_blocks_equal_sequential_greedy(spark, seed):
    edges, lefts, rights, pairs = block_edges(seed)
    member = "household_id string, block string, id string, at bigint"
    df = spark.createDataFrame(edges, "household_id string, k int, l string, r string, _ln bigint, _rn bigint")
    got = assign.greedy_pairs(df, "l", "r", [F.col("k")], (spark.createDataFrame(lefts, member), spark.createDataFrame(rights, member)))
    assert got.columns == ["household_id", "k", "l", "r"]
    assert sorted((r.l, r.r) for r in got.collect()) == greedy(pairs)


def test_equal_receipts_and_charges_settle_as_one_block(spark, monkeypatch):
    """500 receipts and 500 charges that differ in their ids only, beside ordinary ones: few rounds, few candidate rows."""
    rounds, candidates_seen = [], []
    put, once = assign.Rounds.put, assign.cut
    monkeypatch.setattr(assign.Rounds, "put", lambda self, df, name: rounds.append(1) or put(self, df, name))
    monkeypatch.setattr(assign, "cut", lambda df, name: (lambda t: (candidates_seen.append(t.count()) if name == "edges" else None, t)[1])(once(df, name)))
    lines = [(f"b{i:03d}", "2024-01-10", -500, "COSTCO") for i in range(500)] + [(f"c{i}", "2024-01-10", -500 - i, "TARGET") for i in range(3)]
    slips = [(H, f"r{i:03d}", "COSTCO", day("2024-01-10"), 500, None) for i in range(500)] + [(H, f"s{i}", "TARGET", day("2024-01-10"), 500 + i, None) for i in range(3)]
    got = match_receipts(bank(spark, lines), spark.createDataFrame(slips, RECEIPTS)).collect()
    assert sorted((r.receipt_id, r.transaction_id) for r in got) == sorted([(f"r{i:03d}", f"b{i:03d}") for i in range(500)] + [(f"s{i}", f"c{i}") for i in range(3)])
    assert len({r.match_id for r in got}) == 503 and len(rounds) <= 3 and sum(candidates_seen) < 100


def test_running_sums_equal_a_walk(spark):
    from centwise.operators.ordered import running

    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), i, rnd.randint(-5, 9)) for i in rnd.sample(range(5000), 3000)]
    got = {(r.g, r.o): (r.total, r.n) for r in running(spark.createDataFrame(rows, "g string, o int, v int").repartition(7), ["g"], [F.col("o")], total=F.col("v"), n=F.lit(1)).collect()}
    seen, want = {}, {}
    for g, o, v in sorted(rows):
        total, n = seen.get(g, (0, 0))
        seen[g] = want[g, o] = (total + v, n + 1)
    assert got == want


def test_only_the_named_parts_of_a_ledger_are_stored(spark, golden, tmp_path):
    ledger = golden if isinstance(golden, engine.Ledger) else golden[-1]
    stored = engine.written(ledger, "events")
    assert stored.items is ledger.items and stored.matches is ledger.matches
    assert sorted(map(str, stored.events.collect())) == sorted(map(str, ledger.events.collect()))


def test_text_is_filled_as_format_string_fills_it(spark):
    rows = spark.createDataFrame([("a{}b", 5, day("2024-01-02")), (None, None, None)], "s string, n bigint, d date")
    one = text.filled("x {} ({}¢, {})", "s", F.col("n"), "d")
    other = F.format_string("x %s (%d¢, %s)", "s", "n", F.date_format("d", "yyyy-MM-dd"))
    assert rows.select(one.alias("one"), other.alias("other")).filter("one <> other OR one IS NULL").isEmpty()


def test_sums_held_as_numbers_choose_what_sums_held_as_bits_choose(spark):
    rng = random.Random(5)
    rows = [([rng.choice([0, 1, 7, 64, 65, 130, rng.randint(0, 300)]) for _ in range(rng.randint(2, split.FEW))], rng.randint(1, 500)) for _ in range(300)]
    df = spark.createDataFrame(rows, "amounts array<bigint>, target bigint")
    a, t = F.col("amounts"), F.col("target")
    found = df.select(split._walk(a, t, *split._numbers(t)).alias("few"), split._walk(a, t, *split._bits(t)).alias("many"), split.first_exact_subset(a, t).alias("out")).collect()
    assert all(r.few == r.many == r.out for r in found) and any(r.out for r in found)


def test_a_name_is_cut_into_grams_once_for_all_households(spark):
    a = spark.createDataFrame([(f"h{i}", "costco whse") for i in range(20)], "household_id string, left_name string")
    assert names._grams(a, "left_name", 0.5).groupBy("gram").count().filter("count > 1").isEmpty()
    b = spark.createDataFrame([(f"h{i}", "costco whse 118") for i in range(0, 20, 2)], "household_id string, right_name string")
    assert names.similar_names(a, b, 0.5).count() == 10


def test_an_interval_touches_fewer_than_two_cells_on_average(spark):
    days = spark.range(-300, 300).select(F.col("id"), cells.touched(F.col("id"), 7).alias("t"))
    assert days.agg(F.max(F.size("t")), F.avg(F.size("t")) < 1.75).first() == (2, True)
    missed = days.withColumn("y", F.explode(F.sequence(F.col("id") - 7, F.col("id") + 7))).filter(~F.array_contains("t", cells.cell(F.col("y"), 7)))
    assert missed.isEmpty()


def test_leading_items_hold_every_first_item(spark):
    from centwise.operators.merge import event_items
    from centwise.operators.rollup import first_items

    links = spark.createDataFrame([("h", "e1", "r2", None), ("h", "e1", "r1", None), ("h", "e2", "r3", "o1"), ("h", "e3", None, "o1"), ("h", "e4", "r4", "o2")], "household_id string, event_id string, receipt_id string, order_id string")
    events = spark.createDataFrame([("h", f"e{i}") for i in range(1, 5)], "household_id string, event_id string")
    receipts = spark.createDataFrame([("h", f"r{i}", "Shop") for i in range(1, 5)], "household_id string, id string, store string")
    lines = [("r1", 2, "cotton shirt"), ("r1", 3, "usb-c cable"), ("r2", 1, "garden hose"), ("r2", 1, "cat litter"), ("r3", 1, "usb-c cable"), ("r3", 1, "cat litter"), ("r3", 2, "pen"), ("r3", None, "hose")]
    slips = spark.createDataFrame([("h", r, f"{r}-{i}", None, d, n) for i, (r, n, d) in enumerate(lines)], "household_id string, receipt_id string, id string, canonical_name string, raw_description string, line_no bigint")
    bought = spark.createDataFrame(
        [("h", "o1", "a", "pen", "s2", 1, False), ("h", "o1", "b", "cat litter", "s1", 2, False), ("h", "o1", "c", "hose", "s1", 1, True), ("h", "o2", "d", "cable", "s", 1, False)],
        "household_id string, order_id string, id string, description string, shipment_id string, item_seq bigint, is_return boolean")
    whole, few = (event_items(events, links, receipts, slips, bought, leading) for leading in (False, True))
    assert sorted(map(tuple, first_items(few).collect())) == sorted(map(tuple, first_items(whole).collect()))
    assert few.count() == 7 and whole.count() == 13

"""File sources on small hand-written files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from centwise.sources.bank_csv import read_bank_csv
from centwise.sources.digital_receipts import fold_savings, read_digital_receipts
from centwise.sources.extractions import read_extractions
from centwise.sources.images import index_images
from centwise.sources.order_csv import read_order_history
from centwise.sources.registry import ImportContext, import_source

D = dt.date
BANK = """Account statement
Prepared for,Somebody

Period,Jan
Note,"two
lines"
Posted Date,Reference Number,Payee,Address,Amount
01/05/2026,1,COSTCO WHSE #0123,"1 Road, Town",-142.87
01/06/2026,2,AMZN Mktp US*RT4K9,,(54.99)
01/07/2026,3,PAYROLL DEPOSIT ACME CORP,,"$2,450.00"
13/45/2026,4,SHELL OIL 5731,,-1.00
01/08/2026,5,,,-1.00
01/08/2026,6,COMCAST CABLE,,abc

01/09/2026,7,TRADER JOES,,5-
01/09/2026,8,TRADER JOES,,5-
"""


def test_bank_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(chr(0xFEFF) + BANK, encoding="utf-8")
    (tmp_path / "b.csv").write_text("just,some\nrows,here\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("Memo,Date,Transaction Amount\nIKEA,2026-02-03,9.50\n", encoding="utf-8")
    rows, rejects = read_bank_csv(spark, str(tmp_path))
    got = sorted((r.posted_date, r.amount_cents, r.direction, r.normalized_merchant) for r in rows.collect())
    assert got == [
        (D(2026, 1, 5), -14287, "debit", "COSTCO WHSE"), (D(2026, 1, 6), -5499, "debit", "AMZN MKTP US"), (D(2026, 1, 7), 245000, "credit", "PAYROLL DEPOSIT ACME CORP"),
        (D(2026, 1, 9), -500, "debit", "TRADER JOES"), (D(2026, 1, 9), -500, "debit", "TRADER JOES"), (D(2026, 2, 3), 950, "credit", "IKEA")]
    assert rows.select("source_row_hash").distinct().count() == 6
    assert sorted(r.reason for r in rejects.collect()) == [
        "missing payee", "no recognizable header row (need date, amount, and payee columns)", "unparseable amount: abc", "unparseable date: 13/45/2026"]


def test_reimport_adds_nothing(spark, tmp_path):
    from centwise.operators.load import insert_or_ignore

    (tmp_path / "a.csv").write_text(BANK, encoding="utf-8")
    ctx = ImportContext("hh", "acct")
    one = import_source(spark, "bank", str(tmp_path / "a.csv"), ctx).tables["transactions"]
    assert insert_or_ignore(one, one, ["dedup_key"]).count() == 0
    assert insert_or_ignore(one.limit(0), one, ["dedup_key"]).count() == 5
    assert import_source(spark, "fax", "x.tiff", ctx).rejects.first().reason == "no adapter supports 'fax'"
    assert import_source(spark, "bank", str(tmp_path / "a.csv"), ImportContext("hh")).tables == {}


def test_cells_beyond_the_header_are_kept(spark, tmp_path):
    wide = ",".join(["x"] * 90)
    (tmp_path / "a.csv").write_text(f"{wide},Date,Amount,Payee\n{wide},2026-01-05,-1.00,SHOP\n{wide},2026-01-05,-1.00,SHOP,first\n{wide},2026-01-05,-1.00,SHOP,\"sec\nond, part\"\n{wide},2026-01-05,abc,SHOP,tail\n", encoding="utf-8")
    rows, rejects = read_bank_csv(spark, str(tmp_path))
    got = rows.collect()
    assert [r.amount_cents for r in got] == [-100] * 3 and len({r.source_row_hash for r in got}) == 3
    assert rejects.first().raw.endswith("|tail") and rejects.first().reason == "unparseable amount: abc"


def test_first_row_of_a_batch_wins(spark):
    from centwise.operators.load import insert_or_ignore

    df = spark.createDataFrame([("a", "z-first"), ("a", "b-second"), ("b", "m")], "k string, v string").coalesce(1)
    assert sorted(r.v for r in insert_or_ignore(df.limit(0), df, ["k"]).collect()) == ["m", "z-first"]
    assert sorted(r.v for r in insert_or_ignore(df.limit(0), df, ["k"], ["v"]).collect()) == ["b-second", "m"]


def test_order_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order ID,Order Date,Total Amount,Product Name\n1,2024-01-02,$3.00,Pen\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Product Name,Total Amount,Order ID,Gift,Order Date\nInk,$4.50,2,no,2024-01-03\n", encoding="utf-8")
    orders, items, rejects = read_order_history(spark, str(tmp_path))
    assert sorted((r.external_order_id, r.order_total_cents, str(r.order_date)) for r in orders.collect()) == [("1", 300, "2024-01-02"), ("2", 450, "2024-01-03")]
    assert sorted(r.description for r in items.collect()) == ["Ink", "Pen"] and rejects.count() == 0


def test_missing_key_parts_never_conflict(spark):
    from centwise.operators.load import insert_or_ignore

    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert sorted(r.v for r in insert_or_ignore(df.filter("v = 9"), df, ["k"]).collect()) == [1, 3, 4]


ORDERS = '''"Order ID","Order Date","Ship Date","Total Amount","Shipment Item Subtotal","Product Name","Original Quantity","Unit Price","Payment Method Type","Shipping Address"
"001","2026-02-09T10:00:00Z","2026-02-10T01:00:00Z","$12.50","","Cable, 2 ""m""
long","2","6.25","Visa","secret street"
"001","2026-02-09T10:00:00Z","2026-02-10T09:00:00Z","","11.98","Pen","x","bad","Visa","secret street"
"001","2026-02-09T10:00:00Z","","1.00","","Cap","0","","Visa","secret street"
"002","2026-02-11","soon","24.00","","Shirt","1","24","Gift Card","secret street"
"002","2026-02-11","soon","-24.00","","Shirt","1","24","Gift Card","secret street"
"","2026-02-11","","1.00","","Lost","1","","Visa","x"
"003","2026-02-11","","free","","Thing","1","","Visa","x"
"004","yesterday","","1.00","","Thing","1","","Visa","x"
'''


def test_order_history(spark, tmp_path):
    (tmp_path / "o.csv").write_text(ORDERS, encoding="utf-8")
    orders, items, rejects = read_order_history(spark, str(tmp_path / "o.csv"))
    assert {r.external_order_id: (r.order_total_cents, r.order_date, r.currency) for r in orders.collect()} == {"001": (2548, D(2026, 2, 9), "USD"), "002": (0, D(2026, 2, 11), "USD")}
    got = sorted((r.external_order_id, r.shipment_id, r.item_seq, r.amount_cents, r.quantity, r.refund_destination) for r in items.collect())
    assert got == [
        ("001", "2026-02-10", 1, 1250, 2, None), ("001", "2026-02-10", 2, 1198, 1, None), ("001", "unshipped", 1, 100, 1, None), ("002", "soon", 1, 2400, 1, None), ("002", "soon", 2, -2400, 1, "gift_card")]
    assert sorted((r.row_ref, r.reason) for r in rejects.collect()) == [("row:7", "missing Order ID"), ("row:8", "unparseable amount: free"), ("row:9", "unparseable Order Date: yesterday")]
    assert not any("secret" in str(r) for df in (orders, items, rejects) for r in df.collect())


def record(**kw):
    base = {"documentType": "WarehouseReceiptDetail", "transactionBarcode": "b1", "transactionDate": "2026-01-05", "transactionType": "Sales", "receiptType": "In-Warehouse", "membershipNumber": "111222"}
    return {**base, **kw}


def line(amount, desc, **kw):
    return {"amount": amount, "itemNumber": kw.pop("no", "1"), "itemDescription01": desc, **kw}


def test_digital_receipts(spark, tmp_path):
    sale = record(total=109.0, taxes=0.92, tenderArray=[{"displayAccountNumber": "****1234", "tenderDescription": "VISA"}], itemArray=[
        line(28.49, "OIL", itemActualName="Olive Oil"), line(-5.60, "/OIL"), line(10.99, "EGGS", itemActualName="Eggs 24"), line(0.10, "CA REDEMP VAL", itemDepartmentNumber=0), line("74.10", "TV")])
    refund = record(transactionBarcode="b2", transactionType="Refund", total=-10.99, tenderArray=[{"tenderDescription": "Shop Card"}], itemArray=[line(-12.99, "EGGS", itemActualName="EGGS"), line(-2.0, "/EGGS")])
    gas = record(transactionBarcode="b3", documentType="FuelReceipts", receiptType="Gas Station", total=56.77, itemArray=[line(56.77, "REG", fuelUnitQuantity=12.345, fuelGradeCode="1", fuelGradeDescription="REGULAR", itemUnitPriceAmount=4.60)])
    flagged = record(transactionBarcode="b4", total=-1.0, itemArray=[line(-1.0, "/X"), line("oops", "Y"), line(-1.0, "/Y"), line(-1.0, "Z")])
    (tmp_path / "a.json").write_text(json.dumps([sale, refund, record(documentType="Hotel", total=1), record(transactionBarcode="", total=1), record(transactionBarcode="b9")]))
    (tmp_path / "b.json").write_text(json.dumps({"receipts": [gas]}))
    (tmp_path / "c.json").write_text(json.dumps({"data": {"receiptsWithCounts": {"receipts": [flagged]}}}))
    (tmp_path / "d.json").write_text("{nope")
    heads, items, rejects = read_digital_receipts(spark, str(tmp_path))
    by = {r.barcode: r for r in heads.collect()}
    assert {b: (r.total_cents, r.needs_review, r.payment_last4, r.store) for b, r in by.items()} == {
        "b1": (10900, False, "1234", "COSTCO WHSE"), "b2": (-1099, False, None, "COSTCO WHSE"), "b3": (5677, False, None, "COSTCO GAS"), "b4": (-100, True, None, "COSTCO WHSE")}
    rows = items.join(heads.select("entry", "barcode"), "entry")
    got = {(r.barcode, r.line_no): (r.line_price_cents, r.discount_cents, r.canonical_name, r.needs_review) for r in rows.collect()}
    assert got == {
        ("b1", 1): (2849, 560, "Olive Oil", False), ("b1", 2): (1099, 0, "Eggs 24", False), ("b1", 3): (10, 0, "California Redemption Value (CRV)", False), ("b1", 4): (7410, 0, None, True),
        ("b2", 1): (-1099, 0, None, True), ("b3", 1): (5677, 0, "Regular Gasoline", False), ("b4", 1): (-100, 0, None, True)}
    assert rows.filter("barcode = 'b2'").first().refund_destination == "gift_card"
    reasons = sorted(r.reason for r in rejects.collect())
    assert reasons == sorted([
        "unsupported documentType 'Hotel'", "missing transactionBarcode", "missing total", "not valid JSON", 'instant-savings line "/X" has no preceding item',
        'instant-savings line "/Y" has no preceding item', "line without a numeric amount (item 1)"])


def fold(lines):
    items, orphans, emitted = [], [], False
    for pos, kind, amount in lines:
        if kind == "bad":
            emitted = False
        elif kind == "item":
            items.append([pos, amount, 0])
            emitted = True
        elif not emitted:
            orphans.append(pos)
        elif items[-1][1] < 0:
            items[-1][1] += abs(amount)
        else:
            items[-1][2] += abs(amount)
    return items, orphans


def test_savings_fold_equals_the_walk(spark):
    rnd = random.Random(4)
    rows, want, lost = [], [], []
    for r in range(120):
        lines = [(p, rnd.choice(["item", "savings", "savings", "bad"]), rnd.randint(-9, 9)) for p in range(rnd.randint(1, 9))]
        rows += [(r, p, k, a, "h") for p, k, a in lines]
        items, orphans = fold(lines)
        want += [(r, *i) for i in items]
        lost += [(r, p) for p in orphans]
    df = spark.createDataFrame(rows, "r int, pos bigint, kind string, amount bigint, row_hash string")
    items, orphans = fold_savings(df, ["r"])
    assert sorted((x.r, x.pos, x.line_price_cents, x.discount_cents) for x in items.collect()) == sorted(want)
    assert sorted((x.r, x.pos) for x in orphans.collect()) == sorted(lost)


def test_extractions(spark, tmp_path):
    item = {"sku": "1", "rawDescription": "A", "quantity": 1, "unitPrice": None, "linePrice": 500, "discount": 0}
    good = {"household_id": "h", "image_hash": "g", "readable": True, "store": "S", "purchasedAt": "2026-01-01", "total": 505, "tax": None, "paymentHint": {"method": "card", "last4": "1234"}, "fees": [{"kind": "bag", "label": "B", "amount": 5}], "lineItems": [item]}
    variants = [
        good, {**good, "image_hash": "float", "total": 5.05}, {**good, "image_hash": "neg", "lineItems": [{**item, "discount": -1}]}, {**good, "image_hash": "fee", "fees": [{"kind": "tip", "label": "T", "amount": 1}]},
        {**good, "image_hash": "dark", "readable": False}, {"household_id": "h", "image_hash": "bare", "readable": True, "total": 0},
    ]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, variants)))
    got = {r.image_hash: (r.readable, len(r.lines), len(r.fees)) for r in read_extractions(spark, str(tmp_path)).collect()}
    assert got == {"g": (True, 1, 1), "float": (False, 0, 0), "neg": (False, 0, 0), "fee": (False, 0, 0), "dark": (False, 0, 0), "bare": (True, 0, 0)}


def test_images(spark, tmp_path):
    import hashlib

    (tmp_path / "a.png").write_bytes(b"one")
    (tmp_path / "b.JPG").write_bytes(b"two")
    (tmp_path / "c.gif").write_bytes(b"three")
    from centwise.config import ReceiptConfig

    images, rejects = index_images(spark, str(tmp_path))
    assert {(r.media_type, r.image_hash) for r in images.collect()} == {("image/png", hashlib.sha256(b"one").hexdigest()), ("image/jpeg", hashlib.sha256(b"two").hexdigest())}
    assert [r.reason for r in rejects.collect()] == ["MIME_REJECTED"]
    assert {r.reason for r in index_images(spark, str(tmp_path), ReceiptConfig(max_image_bytes=2))[1].collect()} == {"MIME_REJECTED", "SIZE_EXCEEDED"}


def test_a_wide_record_widens_no_other_and_the_file_is_read_once(spark, tmp_path):
    from centwise.sources.csv_cells import csv_cells

    wide = "Some, text " * 25_000
    (tmp_path / "x.csv").write_text(f'Date,Amount,Payee\n01/02/2024,-5.00,"{wide}"\n01/03/2024,-6.00,{"," * 50_000}end\n01/04/2024,-7.00,"two\nlines, ""quoted"""\nalone\n', encoding="utf-8")
    cells = [r.cells for r in csv_cells(spark, str(tmp_path)).orderBy("pos").collect()]
    assert [len(c) for c in cells] == [3, 3, 50_003, 3, 1]
    assert cells[1][2] == wide and cells[2][2:4] == [None, None] and cells[2][-1] == "end" and cells[3][2] == 'two\nlines, "quoted"' and cells[4] == ["alone"]
    plan = csv_cells(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    rows, rejects = read_bank_csv(spark, str(tmp_path))
    assert sorted(r.amount_cents for r in rows.collect()) == [-700, -500]
    assert sorted(r.reason for r in rejects.collect()) == ["missing payee", "unparseable date: alone"]


def test_rows_are_not_shuffled_to_meet_their_header(spark, tmp_path):
    (tmp_path / "o.csv").write_text(ORDERS, encoding="utf-8")
    (tmp_path / "b.csv").write_text(BANK, encoding="utf-8")
    _, _, order_rejects = read_order_history(spark, str(tmp_path / "o.csv"))
    _, bank_rejects = read_bank_csv(spark, str(tmp_path / "b.csv"))
    for rejects in (order_rejects, bank_rejects):
        plan = rejects._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(file" not in plan and "SortAggregate" not in plan


def test_header_words_may_be_spelled_with_signs_and_in_other_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Update of the amount,for the payee\nTrans. Date,Debit / Credit,Mer-chant\n01/05/2026,-1.00,SHOP\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Amount,Da\n01/05/2026,-1.00\n", encoding="utf-8")
    rows, rejects = read_bank_csv(spark, str(tmp_path))
    assert [(r.amount_cents, r.raw_merchant) for r in rows.collect()] == [(-100, "SHOP")]
    assert [r.row_ref for r in rejects.collect()] == ["b.csv"]


def test_rejects_of_digital_receipts_shuffle_no_sound_receipt(spark, tmp_path):
    line = {"amount": "2.00", "itemNumber": "1", "itemDescription01": "PEN"}
    off = {"amount": "-0.50", "itemNumber": "1", "itemDescription01": " /1"}
    sound = record(transactionBarcode="ok", total="1.50", itemArray=[line, off])
    opening = record(transactionBarcode="b", total="2.00", itemArray=[off, line, off])
    unread = record(transactionBarcode="c", total="2.00", itemArray=[line, {**line, "amount": "?"}, off])
    (tmp_path / "r.json").write_text(json.dumps([sound, opening, unread]), encoding="utf-8")
    receipts, _, rejects = read_digital_receipts(spark, str(tmp_path))
    assert sorted((r.row_ref, r.reason) for r in rejects.collect()) == [
        ("b", 'instant-savings line "/1" has no preceding item'), ("c", 'instant-savings line "/1" has no preceding item'), ("c", "line without a numeric amount (item 1)")]
    assert {r.barcode: r.needs_review for r in receipts.collect()} == {"ok": False, "b": True, "c": True}
    # a receipt is looked at before its lines are listed
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") >= 2


def test_readings_are_written_compressed_and_dealt_without_hashes(spark):
    import os

    from centwise.operators import dictionary, receipts
    from centwise.registry import imports
    from centwise.registry.stored import household

    d = "/root/testdata/sf0.001"
    path = imports._reading_files(spark, d).removeprefix("file://")
    assert {n.rsplit(".", 1)[-1] for n in os.listdir(path) if n.startswith("part-")} == {"gz"}
    heads, items = receipts.build_receipts(read_extractions(spark, path), dictionary.rekey(household(spark, d, "sku_dictionary")))
    # a receipt is hashed once, when it is put out, not once a line before lines are dealt
    assert heads._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert items.join(heads, items.receipt_id == heads.id, "left_anti").count() == 0

"""Household tables: what a query derives, and lines numbered before they meet their parts."""

import os
import re

import pytest
from pyspark.sql import functions as F

from centwise import derived
from centwise.registry import catalog, engine, stored

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture
def fresh(monkeypatch):
    """Nothing stored yet; gives the names of the tables derived."""
    seen = []
    monkeypatch.setattr(stored, "_written", {})
    for name in ("lines", "transactions", "orders", "receipts", "store_credit", "matches", "confirmed"):
        monkeypatch.setattr(derived, name, lambda spark, d, _f=getattr(derived, name), _n=name, **k: (seen.append(_n), _f(spark, d, **k))[1])
    return seen


@pytest.mark.parametrize("name", ["order_split", "order_direct"])
def test_orders_meet_their_charges_without_lines(spark, fresh, name):
    catalog.all_queries()[name](spark, DATA)
    assert sorted(fresh) == ["orders", "transactions"]


def test_lines_are_derived_once(spark, fresh):
    i = engine.inputs(spark, DATA)
    assert all(df.columns for df in (i.order_items, i.receipts, i.receipt_items, i.accruals))
    assert stored.household(spark, DATA, "matches").columns
    assert fresh.count("lines") == 1 and "confirmed" not in fresh


def test_lines_without_a_part_are_not_counted(spark, tmp_path):
    for t in ("orders", "lineitem", "part"):
        os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    whole = derived.lines(spark, DATA).cache()
    lost = whole.filter("ln = 1 AND side = 'receipt'").select("partkey").orderBy("partkey").first()["partkey"]
    os.remove(tmp_path / "part.parquet")
    derived.table(spark, DATA, "part").filter(F.col("p_partkey") != lost).write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["k"], r["ln"]): r["seq"] for r in derived.lines(spark, str(tmp_path)).filter("side = 'receipt'").collect()}
    want = {}
    for r in sorted(whole.filter("side = 'receipt'").collect(), key=lambda r: (r["k"], r["ln"])):
        if r["partkey"] != lost:
            want[r["k"], r["ln"]] = 1 + sum(k == r["k"] for k, _ in want)
    assert got == want and any(seq != ln for (_, ln), seq in got.items())


@pytest.mark.parametrize("name, kind", [("digital_receipts", "json"), ("bank_csv_rows", "csv"), ("order_history_orders", "csv"), ("all_rejects", "csv"), ("all_rejects", "json")])
def test_text_is_parsed_once(spark, name, kind):
    plan = catalog.all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert f"FileScan {kind}" not in plan and "FileScan parquet" in plan


@pytest.mark.parametrize("name", ["decision_outcomes", "decided_receipt_items"])
def test_decisions_are_judged_once(spark, name):
    plan = catalog.all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*payload_json", plan)) == 1

"""Registered queries: the contract, plan shapes, and a sample against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from centwise.registry import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")

SAMPLE = [
    "household_transactions", "household_receipt_items", "amount_to_cents", "to_date_any", "normalize_store", "document_categories", "sensitive_documents", "receipt_candidates", "order_matches",
    "decided_matches", "return_accrual_links", "insert_or_ignore", "synced_matches", "true_spend_items", "review_queue", "charge_summary", "learned_merchants", "dictionary_learned", "decision_outcomes", "decided_match_rows",
    "bank_csv_rows", "order_history_items", "digital_receipt_items", "built_receipts", "feed_changes", "even_sample",
]
# plans that need no loop can be looked at without running anything big
SHAPES = ["receipt_candidates", "order_direct", "order_split", "return_accrual_links", "true_spend_breakdown", "review_queue", "synced_matches", "resolved_items", "decision_outcomes", "document_categories", "receipt_arithmetic"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    queries, sql = catalog.all_queries(), catalog.all_check_sql()
    assert len(queries) > 120 and set(queries) == set(sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["household_id", "category", "month", "net_spend_cents", "events"]


@pytest.mark.parametrize("name", SHAPES)
def test_plan_shape(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for word in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]:
        assert word not in plan


def test_filters_reach_the_scan(spark):
    from centwise.registry.stored import household

    bank = household(spark, DATA, "transactions").filter("NOT pending AND direction = 'debit'").select("id", "amount_cents")
    plan = bank._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(direction,debit)" in plan and "raw_merchant" not in plan.split("ReadSchema")[1]

"""The household tables themselves."""

from centwise import derived
from centwise.registry.catalog import query

_TABLES = {
    "household_transactions": (derived.transactions, "v_tx"),
    "household_orders": (derived.orders, "v_orders"),
    "household_order_items": (derived.order_items, "v_order_items"),
    "household_receipts": (derived.receipts, "v_receipts"),
    "household_receipt_items": (derived.receipt_items, "v_receipt_items"),
    "household_store_credit": (derived.store_credit, "v_credit"),
    "household_accounts": (derived.accounts, "v_accounts"),
    "household_matches": (derived.matches, "v_matches"),
    "household_decisions": (derived.review_decisions, "v_decisions"),
    "household_confirmed": (derived.confirmed, "v_confirmed"),
}

for _name, (_fn, _fragment) in _TABLES.items():
    query(_name, f"SELECT * FROM {_fragment}")(_fn)

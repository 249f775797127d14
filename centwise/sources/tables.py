"""Stored tables scoped and shaped into the engine's inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from centwise.operators.matching import first_manual_links

KEY = "household_id"


@dataclass(frozen=True)
class Inputs:
    bank: DataFrame
    orders: DataFrame
    order_items: DataFrame
    receipts: DataFrame
    receipt_items: DataFrame
    accruals: DataFrame
    confirmed: DataFrame


def scoped(df: DataFrame, household_id: str | None = None) -> DataFrame:
    """Rows of one household, or all of them."""
    return df if household_id is None else df.filter(F.col(KEY) == household_id)


def posted_only(transactions: DataFrame) -> DataFrame:
    return transactions.filter(~F.col("pending"))


def dated_credit(credit: DataFrame, order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Credit rows with the order they belong to; dated by it, else by their own creation day."""
    item = order_items.select(KEY, F.col("id").alias("order_item_id"), "order_id")
    order = orders.select(KEY, F.col("id").alias("order_id"), "order_date")
    return credit.join(item, [KEY, "order_item_id"], "left").join(order, [KEY, "order_id"], "left").select(
        "id", KEY, "kind", "amount_cents", F.coalesce("order_date", "created_on").alias("occurred_on"), "order_id", "order_item_id"
    )


def load_inputs(
    transactions: DataFrame, orders: DataFrame, order_items: DataFrame, receipts: DataFrame, receipt_items: DataFrame,
    credit: DataFrame, matches: DataFrame | None = None, confirmed: DataFrame | None = None, household_id: str | None = None,
) -> Inputs:
    """The engine's view of the stored tables; ``confirmed`` defaults to what the manual match rows say."""
    if confirmed is None:
        if matches is None:
            raise ValueError("give the stored matches or the confirmed links")
        confirmed = first_manual_links(matches)
    given = {
        "transactions": transactions, "orders": orders, "order_items": order_items, "receipts": receipts, "receipt_items": receipt_items,
        "store_credit": credit, "confirmed": confirmed,
    }
    lazy = LazyInputs(given.__getitem__, household_id)
    return Inputs(**{f.name: getattr(lazy, f.name) for f in fields(Inputs)})


class LazyInputs:
    """The fields of :class:`Inputs`, each read from the stored tables when it is first used."""

    def __init__(self, table: Callable[[str], DataFrame], household_id: str | None = None):
        self._table = lambda name: scoped(table(name), household_id)

    @cached_property
    def bank(self) -> DataFrame:
        return posted_only(self._table("transactions")).select(KEY, "id", "account_id", "posted_date", "amount_cents", "direction", "normalized_merchant")

    @cached_property
    def orders(self) -> DataFrame:
        return self._table("orders").select(KEY, "id", "external_order_id", "order_date", "order_total_cents")

    @cached_property
    def order_items(self) -> DataFrame:
        return self._table("order_items").select(KEY, "id", "order_id", "shipment_id", "item_seq", "description", "amount_cents", "is_return", "refund_destination")

    @cached_property
    def receipts(self) -> DataFrame:
        return self._table("receipts")

    @cached_property
    def receipt_items(self) -> DataFrame:
        return self._table("receipt_items")

    @cached_property
    def accruals(self) -> DataFrame:
        return dated_credit(self._table("store_credit"), self._table("order_items"), self._table("orders"))

    @cached_property
    def confirmed(self) -> DataFrame:
        return self._table("confirmed")

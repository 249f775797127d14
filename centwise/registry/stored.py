"""Household tables as stored tables: derived once per source folder, then read like any other table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from centwise import derived
from centwise.storage import new_path

_written: dict[tuple[str, str, str], tuple[str, object]] = {}

#: Tables that build on other stored ones, so that lines meet their orders and parts once for all of them.
_FROM = {
    "order_items": ["lines"], "receipt_items": ["lines"], "receipts": ["lines"], "store_credit": ["order_items"], "matches": ["receipt_items", "order_items"],
    "sku_dictionary": ["receipts", "receipt_items"], "incoming_decisions": ["receipts", "receipt_items", "transactions"],
}
#: Selections from a stored table, not written a second time.
_SELECTED = {"order_items", "receipt_items"}


def household(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name in _SELECTED:
        return _derive(spark, d, name)
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        df = _derive(spark, d, name)
        path = new_path(spark, f"household-{name}")
        df.write.parquet(path)
        _written[key] = (path, df.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def _derive(spark: SparkSession, d: str, name: str) -> DataFrame:
    return getattr(derived, name)(spark, d, **{f"{n}_": household(spark, d, n) for n in _FROM.get(name, [])})

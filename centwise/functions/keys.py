"""Hash keys that make loads idempotent."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUL = chr(0)


def joined(*parts: Column) -> Column:
    """Fields joined by NUL; a missing field counts as empty and keeps its place."""
    return F.concat_ws(NUL, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def hash_of(*parts: Column) -> Column:
    return F.sha2(joined(*parts), 256)


def row_hash(cells: Column) -> Column:
    """Hash over every raw cell of a row held as an array of strings."""
    return F.sha2(F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), NUL), 256)


def dedup_key(account: Column, posted: Column, cents: Column, merchant: Column, source_hash: Column) -> Column:
    return hash_of(account, F.date_format(posted, "yyyy-MM-dd"), cents, merchant, source_hash)

"""Equal rows as one: a quotient of the candidates.

Rows that differ in nothing but their id have the same candidates with the same
scores.  They are one block, known by its lowest id, and two blocks have one edge
between them, however many rows stand behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from centwise.operators.ordered import running
from centwise.storage import cut

KEY = "household_id"


def blocks(df: DataFrame, ident: str, size: str) -> DataFrame:
    """One row per set of rows equal but for ``ident``: its lowest ``ident``, and how many there are in ``size``."""
    rest = [c for c in df.columns if c != ident]
    return df.groupBy(*rest).agg(F.min(ident).alias(ident), F.count("*").alias(size)).select(*df.columns, size)


def members(df: DataFrame, whole: DataFrame, ident: str, size: str) -> DataFrame:
    """(household, block, id, at) of every row whose block ``whole`` holds more than one; ``at`` counts from 0 by id."""
    # as a rule few blocks hold several rows: written, they have a size that the planner knows, and ``df`` need not be shuffled to meet them
    many = cut(whole.filter(F.col(size) > 1).select(*[F.col(c).alias("_block" if c == ident else f"_{c}") for c in df.columns]), "many")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in df.columns if c != ident])
    rows = cut(df.join(many, same).select(KEY, F.col("_block").alias("block"), F.col(ident).alias("id")), "alike")
    return cut(running(rows, [KEY, "block"], [F.col("id")], at=F.lit(1).cast("bigint")).withColumn("at", F.col("at") - 1), "members")

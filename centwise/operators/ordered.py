"""Positions and running sums along an order, without a task that holds a whole group.

Rows are dealt by range of (group, order), so a large group spans several
tasks.  Each task counts or sums its own stretch; a group's stretches, one small
row each, tell where the next one starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from centwise.storage import cut


def running(df: DataFrame, group: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of that value over the group's rows up to and including this one."""
    dealt = cut(df.repartitionByRange(*map(F.col, group), *order).withColumn("_stretch", F.spark_partition_id()), "ordered")
    stretch = [*group, "_stretch"]
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*stretch).agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    starts = totals.select(*stretch, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy(*stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *[F.sum(v).over(own).alias(n) for n, v in sums.items()]).join(starts, stretch)
    return summed.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])

"""Interval conditions turned into equality on grid cells.

A value within ``radius`` of a point lies in one of at most two cells of width
``2 * radius + 1`` or more.  One side names its cell, the other names the cells its
interval touches, and the exact condition is checked on the joined rows.  Cells are
twice as wide as they must be: an interval then touches one and a half on average, not two.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


WIDTHS = 2


def cell(value: Column, radius: int) -> Column:
    return F.floor(value / F.lit(WIDTHS * (2 * radius + 1))).cast("bigint")


def touched(value: Column, radius: int) -> Column:
    return F.sequence(cell(value - radius, radius), cell(value + radius, radius))

"""Rounded numbers as columns; halves go to the even neighbour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(n: Column, total: Column) -> Column:
    """A percentage with one decimal; 0 of nothing is 0."""
    return F.coalesce(F.bround(F.try_divide(n * F.lit(100.0), total), 1), F.lit(0.0))


def whole(x: Column) -> Column:
    """Text of a number without decimals."""
    return F.bround(x, 0).cast("bigint").cast("string")


def bar(n: Column, most: Column, cells: int = 20) -> Column:
    """A bar of ``cells`` cells, filled in proportion."""
    filled = F.coalesce(F.floor(F.try_divide(n, most) * F.lit(cells)), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled))

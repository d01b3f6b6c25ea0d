"""Order-independent money aggregates: sum in integer cents.

Floating sums depend on the order partitions are combined in; amounts with
two decimals summed as cents are exact in any order and on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100, 0).cast("long")


def money_sum(c: str | Column) -> Column:
    """Exact sum of a 2-decimal column (0.0 when empty)."""
    return F.coalesce(F.sum(cents(c)), F.lit(0)).cast("double") / F.lit(100.0)


def money_avg(c: str | Column, digits: int = 4) -> Column:
    return F.bround(F.sum(cents(c)).cast("double") / F.lit(100.0) / F.count(c), digits)

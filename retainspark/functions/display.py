"""Display forms of values and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_euros(c: Column) -> Column:
    """1234.5 -> "\u20ac1,234": half-even, with separators."""
    return F.concat(F.lit("\u20ac"), F.format_number(F.bround(c, 0), 0))


def percent(c: Column, digits: int = 1) -> Column:
    """0.1234 -> "12.3%"."""
    return F.format_string(f"%.{digits}f%%", F.bround(c * 100, digits))


def cut(c: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(c, 1, n)


def before(c: Column, mark: str) -> Column:
    """What stands before the first ``mark``; all of it if there is none."""
    return F.substring_index(c, mark, 1)


def direction(c: Column) -> Column:
    """An arrow for a reason that raises or lowers the risk."""
    return F.when(F.contains(c, F.lit("increases")), "\u2191").otherwise("\u2193")

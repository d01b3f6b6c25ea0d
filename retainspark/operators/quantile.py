"""Whole-table quantiles with linear interpolation (pandas / DuckDB
``quantile_cont`` semantics), as used by F8 and V4.

One path at every size.  The value of each wanted rank is enclosed between two
data values with a quantile sketch, whose rank error is bounded; one aggregate
then counts what lies below, on and between the two.  A rank on either value is
resolved; else the search goes on strictly between them.  As both leave the
range each round, every round makes progress, and as the sketch's error shrinks
the range by a factor of thousands, a few rounds do.  Only sketches and counts
reach the driver, a handful of numbers per wanted quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank accuracy of the sketch: its error is at most rows / ACCURACY.
ACCURACY = 10_000


class _Search:
    """The k-th smallest (0-based) non-null value of a column."""

    def __init__(self, col: str, k: int, n: int):
        self.col, self.k, self.below, self.n = col, k, 0, n
        self.lo = self.hi = self.value = None       # exclusive bounds; None: open

    def inside(self) -> Column:
        x = F.col(self.col).cast("double")
        cond = x.isNotNull()
        if self.lo is not None:
            cond = cond & (x > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (x < F.lit(self.hi))
        return F.when(cond, x)

    def shares(self) -> tuple[float, float]:
        """Shares of the range that enclose the rank whatever the sketch's error."""
        at, slack = (self.k - self.below + 0.5) / self.n, 1.5 / ACCURACY
        return max(0.0, at - slack), min(1.0, at + slack)


def _resolve(df: DataFrame, searches: list[_Search]) -> None:
    while open_ := [s for s in searches if s.value is None]:
        ranges: dict[tuple, list[_Search]] = {}
        for s in open_:
            ranges.setdefault((s.col, s.lo, s.hi), []).append(s)
        sketches, groups = [], list(ranges.values())
        for i, group in enumerate(groups):
            shares = [p for s in group for p in s.shares()]
            sketches.append(F.percentile_approx(group[0].inside(), F.array(*[F.lit(p) for p in shares]), F.lit(ACCURACY)).alias(f"e{i}"))
        edges = df.agg(*sketches).first()
        counts, want = [], []
        for i, group in enumerate(groups):
            for j, s in enumerate(group):
                a, b = edges[f"e{i}"][2 * j:2 * j + 2]
                x = s.inside()
                counts += [F.count_if(x < a), F.count_if(x == a), F.count_if((x > a) & (x < b)), F.count_if(x == b)]
                want.append((s, a, b))
        row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
        for i, (s, a, b) in enumerate(want):
            below, on_a, mid, on_b = row[4 * i:4 * i + 4]
            rank = s.k - s.below
            if rank < below:                        # beyond the sketch's promise, but never lost
                s.hi, s.n = a, below
            elif rank < below + on_a:
                s.value = a
            elif rank < below + on_a + mid:
                s.lo, s.hi, s.below, s.n = a, b, s.below + below + on_a, mid
            elif a != b and rank < below + on_a + mid + on_b:
                s.value = b
            else:
                gone = below + on_a + mid + (on_b if a != b else 0)
                s.lo, s.below, s.n = b, s.below + gone, s.n - gone


def quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[tuple[str, float], float | None]:
    """Exact interpolated quantiles of several columns, all found together;
    None for a column without values."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    searches, plan = {}, {}
    for c, n in zip(cols, counts):
        for q in qs:
            if n:
                at = (n - 1) * q
                lo, hi = math.floor(at), math.ceil(at)
                plan[c, q] = (at, lo, hi)
                for k in (lo, hi):
                    searches.setdefault((c, k), _Search(c, k, n))
    _resolve(df, list(searches.values()))
    out: dict[tuple[str, float], float | None] = {(c, q): None for c in cols for q in qs}
    for (c, q), (at, lo, hi) in plan.items():
        a, b = searches[c, lo].value, searches[c, hi].value
        out[c, q] = a if a == b else (hi - at) * a + (at - lo) * b
    return out


def column_quantiles(df: DataFrame, cols: dict[str, str], q: float) -> DataFrame:
    """One-row DataFrame with the ``q`` quantile of each column under its alias."""
    found = quantiles(df, list(cols), [q])
    row = tuple(found[c, q] for c in cols)
    return df.sparkSession.createDataFrame([row], ", ".join(f"{a} double" for a in cols.values()))

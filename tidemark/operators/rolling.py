"""Sliding extremes and sums by doubling.

A frame of n rows costs n updates per row when Spark evaluates it as a sliding
window. Here level k holds the extreme (or sum) of 2**k neighbouring rows, built from
two level k-1 values with one `lag` or `lead`. Any length is covered by two overlapping
levels for an extreme, and by the levels of its binary digits for a sum, which adds
only values inside the frame. All levels share one shuffle and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extreme:
    """`op` (`max` or `min`) of `source` over `length` rows, named `out`."""

    source: str
    op: str
    length: int
    out: str


def sliding_extremes(
    df: DataFrame, specs: list[Extreme], part: list[str], order: str, ahead: bool = False
) -> DataFrame:
    """Extremes over the current row and its `length - 1` predecessors (or successors when `ahead`).

    Frames are cut at the ends of the series, as in a plain sliding frame; NULLs are skipped.
    """
    window = W.partitionBy(*part).orderBy(order)
    move = F.lead if ahead else F.lag
    pick = {"max": F.greatest, "min": F.least}
    series = sorted({(s.source, s.op) for s in specs})
    top = max(s.length for s in specs).bit_length() - 1

    def level(source: str, op: str, k: int) -> str:
        return f"__{op}_{source}_{k}"

    out = df.withColumns({level(s, o, 0): F.col(s) for s, o in series})
    ready: list[str] = []
    for k in range(0, top + 1):
        if k:
            out = out.withColumns(
                {
                    level(s, o, k): pick[o](
                        F.col(level(s, o, k - 1)), move(level(s, o, k - 1), 2 ** (k - 1)).over(window)
                    )
                    for s, o in series
                }
            )
        due = {}
        for spec in specs:
            if spec.length.bit_length() - 1 == k:
                name = level(spec.source, spec.op, k)
                rest = spec.length - 2**k
                due[spec.out] = pick[spec.op](F.col(name), move(name, rest).over(window)) if rest else F.col(name)
        if due:
            out = out.withColumns(due)
        out = out.drop(*[level(s, o, k - 1) for s, o in series] if k else [])
        ready = [level(s, o, k) for s, o in series]
    return out.drop(*ready)


def sliding_sums(df: DataFrame, sums: dict[str, tuple[str, int]], part: list[str], order: str) -> DataFrame:
    """Sums `{out: (source, length)}` over the current row and its predecessors, cut at the start."""
    window = W.partitionBy(*part).orderBy(order)
    series = sorted({source for source, _ in sums.values()})
    top = max(length for _, length in sums.values()).bit_length() - 1

    def level(source: str, k: int) -> str:
        return f"__sum_{source}_{k}"

    def back(name: str, rows: int) -> Column:
        return F.coalesce(F.lag(name, rows).over(window), F.lit(0.0)) if rows else F.col(name)

    out = df.withColumns({level(s, 0): F.coalesce(F.col(s), F.lit(0.0)) for s in series})
    covered = dict.fromkeys(sums, 0)
    for k in range(0, top + 1):
        if k:
            out = out.withColumns({level(s, k): F.col(level(s, k - 1)) + back(level(s, k - 1), 2 ** (k - 1)) for s in series})
        due = {}
        for name, (source, length) in sums.items():
            if length >> k & 1:
                piece = back(level(source, k), covered[name])
                due[name] = F.col(name) + piece if covered[name] else piece
                covered[name] += 2**k
        if due:
            out = out.withColumns(due)
        if k:
            out = out.drop(*[level(s, k - 1) for s in series])
    return out.drop(*[level(s, top) for s in series])

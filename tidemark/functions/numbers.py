"""Number parsing and arithmetic with NULL for every unknown."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn` of a value that is computed once, however often `fn` names it, and compiled apart from what stands around it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def to_number(c: Column, strip: str = r"[,%\s]") -> Column:
    """Number from text after removing separators; NULL when it is not a finite number."""
    bare = F.regexp_replace(c.cast("string"), strip, "")
    number = F.regexp_extract(bare, NUMERIC_TEXT, 0).try_cast("double")
    return bound(number, finite)


def currency_to_number(c: Column) -> Column:
    """Number from money text such as a rupee amount in crore."""
    return to_number(c, r"[₹,%\s]|Cr\.?")


def pct_change(base: Column, value: Column) -> Column:
    """Percent move from base to value; NULL for a missing value or a zero base."""
    return (value - base) / F.nullif(base, F.lit(0.0)) * 100


def _split(a: Column) -> tuple[Column, Column]:
    """High and low halves of a double's digits, without rounding error."""
    scaled = a * 134217729.0
    high = scaled - (scaled - a)
    return high, a - high


def round_binary(c: Column, digits: int) -> Column:
    """Round the stored binary value, exact ties to even, as Python's `round` and C's `printf` do.

    `F.round` and `F.bround` look at the shortest decimal text of a double instead, so 6.35
    counts as a tie there although the stored value is below it. A small negative keeps its sign.
    """
    scale = float(10**digits)
    size = F.abs(c)
    down = F.floor(size * scale).cast("double")
    middle = down * 2 + 1
    tie = middle / (2 * scale)
    # Sign of tie - middle / (2 * scale), from the exact product of tie and 2 * scale.
    product = tie * (2 * scale)
    (th, tl), (sh, sl) = _split(tie), _split(F.lit(2 * scale))
    error = ((th * sh - product) + th * sl + tl * sh) + tl * sl
    off = (product - middle) + error
    even = F.pmod(down, F.lit(2.0)) == 0
    up = F.when(size > tie, True).when(size < tie, False).when(off > 0, True).when(off < 0, False).otherwise(~even)
    rounded = F.when(up, (down + 1) / scale).otherwise(down / scale)
    return F.when(c < 0, -rounded).when(c == 0, c).otherwise(rounded)


def round_scaled(c: Column, digits: int) -> Column:
    """Round the scaled value to the nearest whole number, ties to even, as NumPy does."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def net_return(entry: Column, exit_: Column, cost: float) -> Column:
    """Percent return after a fixed round-trip cost, not rounded."""
    return (exit_ / entry - 1) * 100 - F.lit(cost)


def with_rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round existing columns by `round_binary`; the inputs are columns of the step before."""
    return df.withColumns({c: round_binary(F.col(c), d) for c, d in digits.items()})


def growth(new: Column, old: Column) -> Column:
    """Percent growth, defined for a positive base only."""
    return F.when(old > 0, (new / old - 1) * 100)


def cagr(values: Column, years: int = 3) -> Column:
    """Yearly growth over `years` of a newest-first array; both ends must be positive."""
    new, old = F.get(values, F.lit(0)), F.get(values, F.lit(years))
    return F.when((new > 0) & (old > 0), (F.pow(new / old, F.lit(1.0 / years)) - 1) * 100)


def band(value: Column, direction: str, thresholds: Sequence[float]) -> Column:
    """How many thresholds the value clears, inclusive; NULL in, NULL out."""
    hit = (lambda t: value >= F.lit(float(t))) if direction == "higher" else (lambda t: value <= F.lit(float(t)))
    total = hit(thresholds[0]).cast("int")
    for t in thresholds[1:]:
        total = total + hit(t).cast("int")
    return total


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def percentile_rank(quantiles: Column, p: Column) -> Column:
    """Place of p in a sorted quantile array: entries at or below it, minus one."""
    return F.when(p.isNotNull(), F.size(F.filter(quantiles, lambda q: q <= p)) - 1)


def candle_shape(trigger: Column, low: Column, close: Column) -> dict[str, Column]:
    """Shape of the signal bar: range, close position, gap to the trigger and risk."""
    width = trigger - low
    return {
        "bar_range_pct": width / close * 100,
        "close_pos_in_bar": F.when(width > 0, (close - low) / width).otherwise(F.lit(1.0)),
        "trigger_gap_pct": (trigger / close - 1) * 100,
        "bar_risk_pct": width / trigger * 100,
    }


def truncated(c: Column) -> Column:
    """Whole number, cut toward zero."""
    return c.cast("long")

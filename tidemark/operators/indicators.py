"""Point-in-time indicators on numbered bars. Every value uses bars up to its own only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import config
from ..functions.numbers import finite
from .bars import by_pos
from .rolling import Extreme, sliding_extremes, sliding_sums
from .smoothing import exp_smooth


def _last(n: int, skip: int = 0) -> WindowSpec:
    return by_pos().rowsBetween(-(n - 1) - skip, -skip)


def _from(pos: int, value: Column) -> Column:
    return F.when(F.col("pos") >= pos, value)


def returns(bars: DataFrame, lengths: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    return bars.withColumns(
        {f"ret_{n}d": finite((F.col("close") / F.lag("close", n).over(by_pos()) - 1) * 100) for n in lengths}
    )


def average_distance(bars: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """Percent from the n-bar mean close; needs four fifths of the n bars."""
    summed = sliding_sums(bars, {f"__s{n}": ("close", n) for n in lengths}, ["symbol"], "pos")
    out = {}
    for n in lengths:
        mean = F.col(f"__s{n}") / F.least(F.col("pos") + 1, F.lit(n))
        out[f"dist_sma{n}"] = finite(_from(int(n * 0.8) - 1, (F.col("close") / mean - 1) * 100))
    return summed.withColumns(out).drop(*[f"__s{n}" for n in lengths])


def true_range() -> Column:
    before = F.lag("close", 1).over(by_pos())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame) -> DataFrame:
    """14-bar mean true range as percent of the close."""
    ranged = bars.withColumn("__tr", true_range())
    value = F.avg("__tr").over(_last(14)) / F.col("close") * 100
    return ranged.withColumn("atr_pct", finite(_from(13, value))).drop("__tr")


def volume(bars: DataFrame) -> DataFrame:
    """Volume against its earlier 20-bar mean, log turnover, and whether 21 bars all had a volume."""
    traded = F.coalesce(F.col("volume"), F.lit(0.0))
    base = bars.withColumn("__v", traded)
    ratio = F.col("__v") / F.nullif(F.avg("__v").over(_last(20, skip=1)), F.lit(0.0))
    turnover = F.log10(F.greatest(F.lit(1.0), F.avg(F.col("close") * F.col("__v")).over(_last(20))))
    known = F.count("volume").over(_last(21)) == F.count(F.lit(1)).over(_last(21))
    return base.withColumns(
        {
            "vol_ratio": finite(_from(20, ratio)),
            "log_turnover": finite(_from(19, turnover)),
            "volume_known": known,
        }
    ).drop("__v")


def high_distance(bars: DataFrame) -> DataFrame:
    """Percent from the highest high of 252 bars; needs 120 bars."""
    peaked = sliding_extremes(bars, [Extreme("high", "max", 252, "__peak")], ["symbol"], "pos")
    value = (F.col("close") / F.col("__peak") - 1) * 100
    return peaked.withColumn("dist_52w_high", finite(_from(119, value))).drop("__peak")


def filter_measures(bars: DataFrame) -> DataFrame:
    """The entry filter's rounded copies: distance from the high, and mean range from the 15th bar on."""
    return atr(high_distance(bars)).withColumns(
        {"filter_dist": F.round("dist_52w_high", 2), "filter_atr": F.round(_from(14, F.col("atr_pct")), 2)}
    )


def up_days(bars: DataFrame) -> DataFrame:
    """Closes above the one before, in the last 10 bars."""
    rise = F.coalesce(F.col("close") > F.lag("close", 1).over(by_pos()), F.lit(False)).cast("int")
    return bars.withColumn("__up", rise).withColumn(
        "up_days_10", _from(9, F.sum("__up").over(_last(10)).cast("int"))
    ).drop("__up")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's relative strength; 100 where there was no loss, and on the first bar."""
    move = F.col("close") - F.lag("close", 1).over(by_pos())
    moved = bars.withColumns({"__gain": F.greatest(move, F.lit(0.0)), "__loss": F.greatest(-move, F.lit(0.0))})
    moved = moved.withColumns(
        {c: F.when(F.col("pos") >= 1, F.col(c)) for c in ("__gain", "__loss")}
    )
    smooth = exp_smooth(moved, {"__gain": "__g", "__loss": "__l"}, 1.0 / n, ["symbol"], first=1)
    # Fading weights leave a remainder below 1e-12 of the first loss; treat it as none.
    strength = F.col("__g") / F.when(F.col("__l") > 1e-12 * F.col("close"), F.col("__l"))
    return smooth.withColumn("rsi14", F.coalesce(100 - 100 / (1 + strength), F.lit(100.0))).drop(
        "__gain", "__loss", "__g", "__l"
    )


def exit_line(bars: DataFrame, span: int = config.EXIT_SPAN) -> DataFrame:
    """Exponential mean of the close over a span; NULL before `span` bars."""
    smooth = exp_smooth(bars, {"close": "__ema"}, 2.0 / (span + 1), ["symbol"])
    return smooth.withColumn("ema", _from(span - 1, F.col("__ema"))).drop("__ema")


def all_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator column, on one shuffle by symbol."""
    out = filter_measures(bars)
    for step in (returns, average_distance, volume, up_days, rsi):
        out = step(out)
    return out

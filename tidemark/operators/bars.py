"""Daily and weekly price bars.

A bar table holds one row per (symbol, date). That key bounds a symbol's history by
the number of calendar days, so windows over one symbol stay small however many
ticks the symbol traded; the ticks themselves only meet partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import dates


def by_pos() -> WindowSpec:
    """A symbol's bars in session order."""
    return W.partitionBy("symbol").orderBy("pos")


def from_ticks(ticks: DataFrame, order: list[str]) -> DataFrame:
    """OHLCV per (symbol, date) from ticks with `px` and `qty`; `order` sorts the ticks of a day."""
    at = F.struct(*order)
    daily = ticks.groupBy("symbol", "date").agg(
        F.min_by("px", at).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", at).alias("close"),
        F.sum("qty").alias("volume"),
    )
    return numbered(daily)


def numbered(bars: DataFrame) -> DataFrame:
    """Add `pos` (session number from 0) and `n_bars` per symbol."""
    by_date = W.partitionBy("symbol").orderBy("date")
    return bars.withColumns(
        {
            "pos": (F.row_number().over(by_date) - 1).cast("int"),
            "n_bars": F.count(F.lit(1)).over(W.partitionBy("symbol")).cast("int"),
        }
    )


def clean(raw: DataFrame) -> DataFrame:
    """Drop rows without a full, positive price range and keep the date only."""
    whole = raw.na.drop(subset=["open", "high", "low", "close"]).where((F.col("high") > 0) & (F.col("low") > 0))
    return whole.withColumn("date", F.to_date("date"))


def completed(bars: DataFrame, now: Column, close_hhmm: str) -> DataFrame:
    """Drop the bar of the current local day while its session is still open."""
    local = dates.local_time(now)
    forming = (F.col("date") == F.to_date(local)) & (F.date_format(local, "HH:mm") < F.lit(close_hhmm))
    return bars.where(~(forming & (F.col("pos") == F.col("n_bars") - 1)))


def since(bars: DataFrame, day: Column, columns: list[str]) -> DataFrame:
    """Bars from a day on, with only the columns asked for; both reach the scan when bars are a table."""
    return bars.where(F.col("date") >= day).select("symbol", "date", *columns)


def weekly(bars: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (symbol, week), Monday based, with the values of its last session."""
    last = F.struct("date", "close", *(extra or []))
    grouped = bars.groupBy("symbol", dates.week_start(F.col("date")).alias("week")).agg(
        F.min("pos").alias("start_pos"),
        F.max("pos").alias("end_pos"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(last, "pos").alias("last"),
        F.max("n_bars").alias("n_bars"),
    )
    return grouped.select(
        "symbol", "week", "start_pos", "end_pos", F.col("last.date").alias("end_date"), "high", "low",
        F.col("last.close").alias("close"), "n_bars", *[F.col(f"last.{c}").alias(c) for c in extra or []],
    )


def week_closed() -> Column:
    """A weekly bar is known once a later session exists or its last session is a Friday or later."""
    return (F.col("end_pos") < F.col("n_bars") - 1) | (dates.weekday(F.col("end_date")) >= 4)

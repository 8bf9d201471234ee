"""As-of joins. Spark has no as-of join; a filled calendar or one union window gives equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_features(index_bars: DataFrame) -> DataFrame:
    """20-session return and distance from the 50-session mean of the index; NULL before 50 sessions.

    The index has one row per day, so its single ordered window is bounded by the calendar.
    """
    by_date = W.orderBy("date")
    place = F.row_number().over(by_date)
    mean50 = F.avg("close").over(by_date.rowsBetween(-49, 0))
    ready = place >= 50
    return index_bars.withColumns(
        {
            "index_ret_20d": F.when(ready, (F.col("close") / F.lag("close", 20).over(by_date) - 1) * 100),
            "index_dist_sma50": F.when(ready, (F.col("close") / mean50 - 1) * 100),
        }
    )


def filled_calendar(index_bars: DataFrame, values: list[str]) -> DataFrame:
    """Each calendar day with the latest index row at or before it (`<v>`) and before it (`<v>_before`)."""
    span = index_bars.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    by_date = W.orderBy("date")
    row = F.struct(*values)
    known = index_bars.select("date", row.alias("__row"))
    joined = days.join(known, "date", "left")
    at = F.last("__row", ignorenulls=True)
    filled = joined.withColumns(
        {
            "__at": at.over(by_date.rowsBetween(W.unboundedPreceding, 0)),
            "__before": at.over(by_date.rowsBetween(W.unboundedPreceding, -1)),
        }
    )
    return filled.select(
        "date",
        *[F.col(f"__at.{v}").alias(v) for v in values],
        *[F.col(f"__before.{v}").alias(f"{v}_before") for v in values],
    )


def snap_to_session(hits: DataFrame, bars: DataFrame, hit: str = "hit_date") -> DataFrame:
    """Add `session_date`: the symbol's latest bar at or before the hit, when a later bar exists.

    Without a bar before the hit, or when the hit is after the last bar, the hit's own date stays.
    """
    left = hits.select("*", F.col(hit).alias("__d"), F.lit(1).alias("__kind"))
    right = bars.select("symbol", F.col("date").alias("__d"), F.lit(0).alias("__kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    bar_day = F.when(F.col("__kind") == 0, F.col("__d"))
    seen = W.partitionBy("symbol").orderBy("__d", "__kind").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns(
        {"__prev": F.last(bar_day, ignorenulls=True).over(seen), "__end": F.max(bar_day).over(W.partitionBy("symbol"))}
    )
    snapped = F.when(F.col("__end") > F.col("__d"), F.coalesce("__prev", "__d")).otherwise(F.col("__d"))
    return both.where(F.col("__kind") == 1).withColumn("session_date", snapped).drop("__d", "__kind", "__prev", "__end")

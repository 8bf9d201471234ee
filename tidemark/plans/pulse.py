"""Market pulse: index trend, volatility mood and breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.keys import beside
from ..operators.bars import numbered


def trend(vs50: Column, vs200: Column) -> Column:
    """Trend class from the distances to the 50- and 200-session means."""
    full = (
        F.when((vs50 > 0) & (vs200 > 0), "Uptrend")
        .when(vs200 > 0, "Pullback in an uptrend")
        .when(vs50 > 0, "Recovering")
        .otherwise("Downtrend")
    )
    short = F.when(vs50 > 0, "Above 50-day average").otherwise("Below 50-day average")
    return F.when(vs50.isNotNull() & vs200.isNotNull(), full).when(vs50.isNotNull(), short)


def mood(level: Column) -> Column:
    return F.when(level < 13, "calm").when(level < 18, "normal").when(level < 25, "nervous").when(level.isNotNull(), "fearful")


def index_pulse(index: DataFrame) -> DataFrame:
    """Latest state of each index `name`: close, day and month change, distance from its means, trend."""
    by_date = W.partitionBy("name").orderBy("date")
    n = F.row_number().over(by_date)

    def mean(k: int) -> Column:
        return F.avg("close").over(by_date.rowsBetween(-(k - 1), 0))

    marks = index.withColumns(
        {
            "n": n, "c1": F.lag("close", 1).over(by_date), "c21": F.lag("close", 21).over(by_date),
            "a50": mean(50), "a200": mean(200), "newest": F.max("date").over(W.partitionBy("name")),
        }
    ).where((F.col("date") == F.col("newest")) & (F.col("n") >= 2))
    out = marks.select(
        "name", "date", F.round("close", 1).alias("close"), F.round((F.col("close") / F.col("c1") - 1) * 100, 2).alias("day"),
        F.when(F.col("n") > 22, F.round((F.col("close") / F.col("c21") - 1) * 100, 1)).alias("month"),
        F.when(F.col("n") >= 50, F.round((F.col("close") / F.col("a50") - 1) * 100, 1)).alias("vs50"),
        F.when(F.col("n") >= 200, F.round((F.col("close") / F.col("a200") - 1) * 100, 1)).alias("vs200"),
    )
    return out.withColumn("trend", trend(F.col("vs50"), F.col("vs200")))


def breadth(bars: DataFrame, fresh_days: int = 5, history_days: int = 110) -> DataFrame:
    """Share of fresh symbols, indexes left out, that close above their own 50-session mean."""
    newest = bars.agg(F.max("date").alias("newest"))
    dated = bars.where(~F.col("symbol").startswith("^")).transform(beside, newest)
    recent = numbered(dated.where(F.col("date") >= F.date_sub("newest", history_days)))
    mean = F.avg("close").over(W.partitionBy("symbol").orderBy("pos").rowsBetween(-49, 0))
    last = recent.withColumn("mean", mean).where(
        (F.col("pos") == F.col("n_bars") - 1) & (F.col("n_bars") >= 50)
        & (F.col("date") >= F.date_sub("newest", fresh_days))
    )
    total = F.count(F.lit(1))
    above = F.count_if(F.col("close") > F.col("mean"))
    return last.agg(
        above.alias("above"), total.alias("total"), F.round(100.0 * above / F.nullif(total, F.lit(0))).cast("long").alias("pct")
    )

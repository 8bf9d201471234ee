"""Performance of value curves against an index over the same days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..operators.keys import beside
from ..operators.books import period_returns


def same_days(index: DataFrame, curve: DataFrame) -> DataFrame:
    """Index rows (date, value) between the curves' first and last day."""
    span = curve.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    # One row: the span.
    return index.transform(beside, span).where(F.col("date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def years(curve: DataFrame, index: DataFrame, by: str = "scanner", capital: float = config.CAPITAL) -> DataFrame:
    """Yearly return of each curve and of the index; the first year starts from the capital."""
    own = period_returns(curve, [by], "year", F.lit(capital))
    bench = same_days(index, curve).withColumn("one", F.lit(1))
    # The index's first year starts from its first value.
    first = bench.groupBy("one").agg(F.min_by("value", "date").alias("first"))
    theirs = period_returns(bench.join(F.broadcast(first), "one"), ["one", "first"], "year", F.col("first"))
    return own.alias("o").join(theirs.alias("i"), "period", "left").select(
        f"o.{by}", F.year("period").alias("year"), F.col("o.ret"), F.col("i.ret").alias("index_ret")
    )


def months(curve: DataFrame, index: DataFrame, by: str = "scanner", capital: float = config.CAPITAL) -> DataFrame:
    """Month-end value of each curve, and of the capital put into the index on the first day."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    own = curve.groupBy(by, month).agg(F.max_by("value", "date").alias("value"))
    bench = same_days(index, curve)
    first = bench.agg(F.min_by("value", "date").alias("first"))
    theirs = bench.groupBy(month).agg(F.max_by("value", "date").alias("v")).transform(beside, first)
    joined = own.join(theirs, "month", "left")
    return joined.select(by, "month", "value", (F.col("v") / F.col("first") * capital).alias("index_value"))

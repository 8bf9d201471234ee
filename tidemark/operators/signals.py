"""Signals: union, tiers, confirmations, signal bars and duplicate orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from ..functions.rules import RuleBook, tier_from_size, tier_priority
from . import bars as bar_ops
from .keys import earliest_values, latest_values

KEY = ["scanner", "symbol", "hit_date"]


def union_hits(sources: list[DataFrame], rules: RuleBook) -> DataFrame:
    """Hits of several sources, earlier sources first; a weekly scanner's hit is its week."""
    both = None
    for i, source in enumerate(sources):
        tagged = source.withColumn("__src", F.lit(i))
        both = tagged if both is None else both.unionByName(tagged)
    slot = F.when(rules.weekly(F.col("scanner")), dates.week_start(F.col("hit_date"))).otherwise(F.col("hit_date"))
    values = [c for c in sources[0].columns if c not in ("scanner", "symbol")]
    first = earliest_values(
        both.withColumn("__slot", slot), ["scanner", "symbol", "__slot"], ["__src", "hit_date"], values
    )
    return first.drop("__slot")


def latest_known(hits: DataFrame) -> DataFrame:
    """Latest non-blank tier of a symbol with its sector."""
    known = hits.where(F.coalesce(F.col("tier"), F.lit("")) != "")
    return latest_values(known, ["symbol"], ["hit_date"], ["tier", "sector"])


def with_tier(rows: DataFrame, hits: DataFrame, size: str | None = None) -> DataFrame:
    """Add `tier` and `priority`: the latest known tier, else one from the size column."""
    known = latest_known(hits).select("symbol", F.col("tier").alias("__known"))
    fallback = tier_from_size(F.col(size)) if size else F.lit(None).cast("string")
    out = rows.join(known, "symbol", "left").withColumn("tier", F.coalesce("__known", fallback)).drop("__known")
    return out.withColumn("priority", tier_priority(F.col("tier")))


def confirmations(signals: DataFrame, days: int = config.CONFIRM_DAYS) -> DataFrame:
    """Add `confirmed_by`: other scanners that hit the symbol within the days before, sorted.

    A range frame over days replaces a self join; it holds at most (days + 1) x scanners rows.
    """
    day = F.datediff(F.col("hit_date"), F.lit("1970-01-01").cast("date"))
    recent = W.partitionBy("symbol").orderBy("__day").rangeBetween(-days, 0)
    seen = F.collect_set("scanner").over(recent)
    return (
        signals.withColumn("__day", day)
        .withColumn("confirmed_by", F.array_sort(F.array_remove(seen, F.col("scanner"))))
        .drop("__day")
    )


def upcoming(longest: int) -> Column:
    """The next `longest` sessions of a bar, so that finding a touch needs no range join.

    Ordered by day, as a join on (symbol, day) wants its rows: these wide rows are not sorted again.
    """
    window = W.partitionBy("symbol").orderBy("date")
    return F.array(
        *[
            F.struct(
                F.lead("date", k).over(window).alias("date"),
                F.lead("open", k).over(window).alias("open"),
                F.lead("high", k).over(window).alias("high"),
            )
            for k in range(1, longest + 1)
        ]
    )


def locate(
    signals: DataFrame, bars: DataFrame, rules: RuleBook, extra: list[str] | None = None, day: str = "hit_date"
) -> DataFrame:
    """Signals with their signal bar: the hit's day, or for weekly scanners the whole closed week.

    Bar columns are NULL where no bar (or no closed week) exists. A week is known at its last
    session, so both kinds of signal read close, later sessions and `extra` from one bar by
    (symbol, date). `day` names the session of a daily hit.
    """
    weeks = bars.groupBy("symbol", dates.week_start(F.col("date")).alias("__week")).agg(
        F.min("pos").alias("__first"), F.max("pos").alias("end_pos"), F.max("date").alias("end_date"),
        F.max("high").alias("__high"), F.min("low").alias("__low"), F.max("n_bars").alias("n_bars"),
    )
    closed = weeks.where(bar_ops.week_closed()).select(
        "symbol", "__week", "__first", F.col("end_date").alias("__date"), "__high", "__low", F.lit(True).alias("weekly")
    )
    keyed = signals.select(
        "*", rules.weekly(F.col("scanner")).alias("weekly"), dates.week_start(F.col("hit_date")).alias("__week")
    )
    dated = keyed.join(closed, ["symbol", "__week", "weekly"], "left").withColumn(
        "__date", F.when(F.col("weekly"), F.col("__date")).otherwise(F.col(day))
    )
    ends = bars.select(
        "symbol", "date", F.col("pos").alias("end_pos"), F.col("high").alias("__bar_high"),
        F.col("low").alias("__bar_low"), F.col("close").alias("bar_close"), "n_bars",
        upcoming(rules.longest_window()).alias("upcoming"), *(extra or []),
    ).withColumnRenamed("date", "__date")  # Renamed after the window, so that its order by day is known to the join.
    found = dated.join(ends, ["symbol", "__date"], "left")
    return found.select(
        *signals.columns, "weekly",
        F.when(F.col("weekly"), F.col("__first")).otherwise(F.col("end_pos")).alias("start_pos"), "end_pos",
        F.when(F.col("end_pos").isNotNull(), F.col("__date")).alias("signal_date"),
        F.when(F.col("weekly"), F.col("__high")).otherwise(F.col("__bar_high")).alias("trigger"),
        F.when(F.col("weekly"), F.col("__low")).otherwise(F.col("__bar_low")).alias("bar_low"),
        "bar_close", "n_bars", "upcoming", *(extra or []),
    )


def mark_duplicates(states: DataFrame) -> DataFrame:
    """Add `duplicate`: an earlier order of the same scanner and symbol is still waiting."""
    earlier = W.partitionBy("scanner", "symbol").orderBy("hit_date").rowsBetween(W.unboundedPreceding, -1)
    waiting = F.max((F.col("status") == "waiting").cast("int")).over(earlier)
    return states.withColumn("duplicate", F.coalesce(waiting == 1, F.lit(False)))

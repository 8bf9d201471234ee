"""Summaries of outcomes and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..operators.keys import beside, pick_per_key


def share(condition: Column) -> Column:
    """Share of rows that meet a condition."""
    return F.avg(condition.cast("double"))


def mean(value: Column) -> Column:
    """Mean of values with two decimals, summed as whole hundredths: the same whatever the row order."""
    return F.sum(F.round(value * 100).cast("long")).cast("double") / F.count(value) / 100


def status_counts(outcomes: DataFrame) -> DataFrame:
    """Signals per scanner by what became of them."""
    names = {"touched": "bought", "no breakout": "not_triggered", "no bar": "no_price_data", "waiting": "pending"}
    return outcomes.groupBy("scanner").agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()]
    )


def horizon_stats(holds: DataFrame) -> DataFrame:
    """Per scanner and horizon: how many rose, mean, exact median, best and worst, and against the index.

    Returns are whole hundredths, so the exact median counts distinct hundredths, not rows.
    """
    rows = holds.where(F.col("horizon").isNotNull())
    ret, idx = F.col("ret"), F.col("index_ret")
    return rows.groupBy("scanner", "horizon").agg(
        F.count(F.lit(1)).alias("n"), share(ret > 0).alias("up"), mean(ret).alias("mean"),
        F.median(ret).alias("median"), mean(F.col("best")).alias("best"), mean(F.col("worst")).alias("worst"), mean(idx).alias("index_mean"),
        F.when(F.count(idx) > 0, share(F.coalesce(ret > idx, F.lit(False)))).alias("beat"),
        mean(ret - idx).alias("excess"),
    )


def group_cells(holds: DataFrame, min_n: int = 10, min_sector: int = 20) -> DataFrame:
    """Cells by tier, year and sector in one pass; figures are hidden under the least count."""
    label = F.explode(
        F.array(
            F.struct(F.lit("tier").alias("dimension"), F.col("tier").alias("grp"), F.lit(min_n).alias("least")),
            *[
                F.struct(F.lit(d).alias("dimension"), c.alias("grp"), F.lit(least).alias("least"))
                for d, c, least in (
                    ("year", F.year("entry_date").cast("string"), min_n), ("sector", F.col("sector"), min_sector),
                )
            ],
        )
    ).alias("g")
    rows = holds.where(F.col("horizon").isNotNull()).select("scanner", "horizon", "ret", "index_ret", label)
    # Blank and NULL are one group, so they share one count.
    group = F.coalesce(F.nullif("g.grp", F.lit("")), F.lit("Unknown")).alias("grp")
    cells = rows.groupBy("scanner", "horizon", "g.dimension", group).agg(
        F.count(F.lit(1)).alias("n"), F.max("g.least").alias("least"), share(F.col("ret") > 0).alias("up"),
        mean(F.col("ret")).alias("mean"), mean(F.col("ret") - F.col("index_ret")).alias("excess"),
    )
    shown = F.col("n") >= F.col("least")
    return cells.select(
        "scanner", "horizon", "dimension", "grp", "n",
        *[F.when(shown, F.col(c)).alias(c) for c in ("up", "mean", "excess")],
    )


def symbol_summary(holds: DataFrame) -> DataFrame:
    """Per scanner and symbol: buys, first and last buy, latest tier and sector, mean and share up per horizon."""
    bought = holds.where(F.col("status") == "bought")
    # A trade has one row per reached horizon, or one row without; count each trade once.
    once = F.col("horizon").isNull() | (F.col("horizon") == config.HORIZONS[0][0])
    stats = []
    for key, _ in config.HORIZONS:
        ret = F.when(F.col("horizon") == key, F.col("ret"))
        stats += [mean(ret).alias(f"avg_{key}"), (F.avg((ret > 0).cast("double")) * 100).alias(f"up_{key}")]
    return bought.groupBy("scanner", "symbol").agg(
        F.count_if(once).alias("signals"), F.min("entry_date").alias("first"), F.max("entry_date").alias("last"),
        F.max_by("tier", F.when(F.col("tier").isNotNull(), F.col("hit_date"))).alias("tier"),
        F.max_by("sector", F.when(F.col("sector").isNotNull(), F.col("hit_date"))).alias("sector"),
        *stats,
    )


def best_and_worst(summary: DataFrame, column: str, n: int = 10, min_trades: int = 3) -> DataFrame:
    """The n symbols with the greatest and the least mean per scanner, ties by symbol."""
    known = summary.where((F.col("signals") >= min_trades) & F.col(column).isNotNull())
    value = F.round(column, 6)
    sides = known.withColumn(
        "__s", F.explode(F.array(F.struct(F.lit("best").alias("side"), (-value).alias("v")), F.struct(F.lit("worst").alias("side"), value.alias("v"))))
    ).select("*", "__s.side", F.col("__s.v").alias("__v")).drop("__s")
    placed = pick_per_key(sides, ["scanner", "side"], [F.col("__v"), F.col("symbol")], n)
    place = F.row_number().over(W.partitionBy("scanner", "side").orderBy("__v", "symbol"))
    return placed.withColumn("place", place).drop("__v")


def scanner_glance(holds: DataFrame) -> DataFrame:
    """One line per scanner: signals, buys and mean returns."""
    first = config.HORIZONS[0][0]
    once = F.col("horizon").isNull() | (F.col("horizon") == first)

    def after(key: str) -> Column:
        return mean(F.when(F.col("horizon") == key, F.col("ret")))

    return holds.groupBy("scanner").agg(
        F.count_if(once).alias("signals"), F.count_if(once & (F.col("status") == "bought")).alias("bought"),
        *[after(key).alias(f"avg_{key}") for key in ("1m", "6m", "1y", "2y")],
        mean(F.when(F.col("horizon") == "1y", F.col("ret") - F.col("index_ret"))).alias("excess_1y"),
    )


def _trade_stats() -> list[Column]:
    ret = F.col("ret")
    return [
        F.count(F.lit(1)).alias("trades"), share(ret > 0).alias("win"), mean(ret).alias("mean"),
        mean(F.when(ret > 0, ret)).alias("mean_win"), mean(F.when(ret <= 0, ret)).alias("mean_loss"),
        F.avg("days").alias("days"),
    ]


def trade_breakdown(trades: DataFrame) -> DataFrame:
    """Trades by scanner, by tier and overall: returns, exit kinds, days and profit on a fixed stake."""
    label = F.explode(
        F.filter(
            F.array(F.col("scanner"), F.nullif("tier", F.lit("")), F.lit("All")), lambda g: g.isNotNull()
        )
    ).alias("grp")
    kinds = [share(F.col("status") == k).alias(f"{k}_share") for k in ("average", "stop", "time")]
    # Returns carry two decimals, so profit adds up in whole units.
    profit = F.sum(F.round(F.col("ret") * 1000).cast("long")).alias("profit")
    return trades.select("*", label).groupBy("grp").agg(*_trade_stats(), *kinds, profit)


def from_common_start(trades: DataFrame) -> DataFrame:
    """Trades from the first day on which every scanner has had one."""
    starts = trades.groupBy("scanner").agg(F.min("entry_date").alias("m")).agg(F.max("m").alias("start"))
    # One row: the common start.
    return trades.transform(beside, starts).where(F.col("entry_date") >= F.col("start")).drop("start")


def trade_rollup(trades: DataFrame) -> DataFrame:
    """Rounded figures per scanner and for all."""
    out = trades.rollup("scanner").agg(*_trade_stats())
    return out.select(
        F.coalesce("scanner", F.lit("All")).alias("scanner"), "trades", F.round(F.col("win") * 100).cast("long").alias("win"),
        F.round("mean", 2).alias("mean"), F.round("mean_win", 1).alias("mean_win"),
        F.round("mean_loss", 1).alias("mean_loss"), F.round("days").cast("long").alias("days"),
    )

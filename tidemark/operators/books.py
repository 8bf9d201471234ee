"""Day order of buys, and value curves of closed trades, as sets: no book is walked row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from ..functions.rules import tier_priority
from ..session import cut
from .keys import pick_per_key


def day_first(trades: DataFrame, orders: tuple[str, ...] = ("tier", "score"), slots: int = config.SLOTS) -> DataFrame:
    """The first `slots` buys of each day, one per symbol, once per order (`book`), with their `place`.

    By `score`, scored trades come first, the best one first; all others stand by tier, then by name. Both limits
    cut rows before their shuffles, so a crowded day sends few rows per task.
    """
    each = trades.withColumn("book", F.explode(F.array(*[F.lit(o) for o in orders])))
    scored = (F.col("book") == "score") & F.col("score").isNotNull()
    place = F.when(scored, -F.col("score")).otherwise(tier_priority(F.col("tier")).cast("double"))
    each = each.withColumn("ord", F.struct(F.when(scored, 0).otherwise(1).alias("g"), place.alias("p"), "scanner", "symbol", "hit_date"))
    per_symbol = pick_per_key(each, ["book", "entry_date", "symbol"], [F.col("ord")])
    nth = F.row_number().over(W.partitionBy("book", "entry_date").orderBy("ord"))
    return per_symbol.withColumn("place", nth).where(F.col("place") <= slots).drop("ord")


PARTS = 8


def _bound(rows: DataFrame, by: list[str], value: str, slots: int) -> DataFrame:
    """Per group a bound that holds `slots` symbols at least: the `slots`-th smallest of the minima of parts of its symbols.

    Parts share no symbol, so their minima belong to different ones. NULL where fewer parts have rows: nothing is cut there.
    The bound only limits what is ranked; the ranking itself is exact.
    """
    part = F.pmod(F.xxhash64("symbol"), F.lit(max(PARTS, 2 * slots))).alias("__part")
    least = rows.groupBy(*by, part).agg(F.min(value).alias("__least"))
    return least.groupBy(*by).agg(F.get(F.sort_array(F.collect_list("__least")), F.lit(slots - 1)).alias("__bound"))


def scenarios(trades: DataFrame, slots: list[int], policies: list[str], seeds: int) -> DataFrame:
    """The first buys of each day under every scenario of a grid: (slots, policy, seed) beside the trade, and `place`.

    `tier` takes tiers in order and shuffles within them, `score` the best score first (unscored trades last, shuffled),
    `random` shuffles all. A shuffle is the order of a seeded hash of the trade's name, so reruns agree. One buy per
    symbol and day. `trades` are read several times. Trades that no seed can reach are cut by their lead, then those that
    a seed cannot reach by the first digits of their hash; only the few others are sorted, once for all numbers of slots.
    The bounds have one row per day, policy and seed, so the calendar limits what is broadcast.
    """
    most = max(slots)
    lead = {
        "tier": tier_priority(F.col("tier")).cast("double"), "score": F.coalesce(-F.col("score"), F.lit(float("inf"))),
        "random": F.lit(0.0),
    }
    policy = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), lead[p].alias("lead")) for p in policies]))
    each = trades.select("*", policy.alias("g")).select(*trades.columns, "g.*")
    days = ["policy", "entry_date"]
    edges = _bound(each, days, "lead", most).withColumnRenamed("__bound", "__edge")
    within = F.col("__edge").isNull() | (F.col("lead") <= F.col("__edge"))
    reached = each.join(F.broadcast(edges), days).where(within)

    name = F.concat_ws("|", F.col("seed").cast("string"), F.col("scanner"), F.col("symbol").cast("string"), F.col("hit_date").cast("string"))
    seeded = reached.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).withColumn("__h", F.md5(name))
    # The first 15 hexadecimal digits order trades as the whole hash does, but for ties, which the bound keeps.
    seeded = seeded.withColumn("__head", F.conv(F.substring("__h", 1, 15), 16, 10).cast("long"))
    tied = F.col("lead") == F.col("__edge")
    bounds = _bound(seeded.where(tied), [*days, "seed"], "__head", most)
    near = seeded.join(F.broadcast(bounds), [*days, "seed"], "left")
    kept = near.where(F.coalesce(~tied, F.lit(True)) | F.col("__bound").isNull() | (F.col("__head") <= F.col("__bound")))

    kept = kept.withColumn("ord", F.struct("lead", F.col("__h").alias("h"), "scanner"))
    scenario = ["policy", "seed", "entry_date"]
    per_symbol = pick_per_key(kept, [*scenario, "symbol"], [F.col("ord")])
    nth = F.row_number().over(W.partitionBy(*scenario).orderBy("ord"))
    placed = per_symbol.withColumn("place", nth).where(F.col("place") <= most)
    books = placed.withColumn("slots", F.explode(F.array(*[F.lit(n) for n in slots]))).where(F.col("place") <= F.col("slots"))
    return books.select(*trades.columns, "slots", "policy", "seed", "place")


def next_workday(day: Column) -> Column:
    """The day itself, or the Monday after a weekend."""
    weekday = dates.weekday(day)
    return F.when(weekday >= 5, F.date_add(day, 7 - weekday)).otherwise(day)


def spread_curve(trades: DataFrame, by: list[str], capital: float = config.CAPITAL) -> DataFrame:
    """Value on every Monday-to-Friday day of a capital dealt evenly over all closed trades of a group.

    Each trade gains its return on the day it closes (or the next workday). Returns carry two decimals and are summed as whole
    hundredths, so the order of rows never shows. A group's curve has one row per day, so its window is bounded by the calendar.
    The days' sums are read twice, for the span and for the values, and cut first: else each reading works out the trades again.
    """
    done = trades.withColumn("date", next_workday(F.col("exit_date")))
    cents = F.sum(F.round(F.col("ret") * 100).cast("long")).alias("cents")
    booked = cut(done.groupBy(*by, "date").agg(cents, F.count(F.lit(1)).alias("closed"), F.min("entry_date").alias("entered")))
    spans = booked.groupBy(*by).agg(F.sum("closed").alias("n"), F.min("entered").alias("lo"), F.max("date").alias("hi"))
    days = spans.select(*by, "n", F.explode(F.sequence("lo", "hi")).alias("date")).where(dates.weekday(F.col("date")) < 5)
    so_far = F.sum("cents").over(W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    gained = F.coalesce(so_far, F.lit(0)).cast("double") / F.lit(10000.0) / F.col("n")
    return days.join(booked, [*by, "date"], "left").select(*by, "date", (F.lit(capital) * (1 + gained)).alias("value"))


def growth_stats(curve: DataFrame, by: list[str]) -> DataFrame:
    """First and last value, yearly growth and worst fall of each curve."""
    peak = F.max("value").over(W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    fallen = curve.withColumn("__fall", (F.col("value") / peak - 1) * 100)
    out = fallen.groupBy(*by).agg(
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"),
        F.min("__fall").alias("max_fall"),
    )
    years = F.datediff("end", "start") / 365.25
    rate = F.when((years > 0) & (F.col("first") > 0), (F.pow(F.col("last") / F.col("first"), 1 / years) - 1) * 100)
    return out.withColumn("cagr", rate)


def period_returns(curve: DataFrame, by: list[str], unit: str, start: Column | None = None) -> DataFrame:
    """Value at each period's end and the change against the previous end; `start` stands before the first."""
    ends = curve.groupBy(*by, F.trunc("date", unit).alias("period")).agg(F.max_by("value", "date").alias("value"))
    before = F.lag("value").over(W.partitionBy(*by).orderBy("period"))
    begin = start if start is not None else F.first("value").over(W.partitionBy(*by).orderBy("period"))
    return ends.withColumn("ret", (F.col("value") / F.coalesce(before, begin) - 1) * 100)

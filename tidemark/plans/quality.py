"""Data-quality checks as rows (name, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import beside
from .. import config
from ..functions import dates


def price_mismatches(states: DataFrame, bars: DataFrame, slack: float = 0.01) -> DataFrame:
    """Trades whose entry or exit lies outside that day's range, or whose open return is off."""
    rows = states.where(F.col("entry_date").isNotNull())
    def day(prefix: str) -> DataFrame:
        return bars.select(
            "symbol", F.col("date").alias(f"{prefix}_date"), F.col("low").alias(f"__{prefix}_low"), F.col("high").alias(f"__{prefix}_high")
        )

    both = rows.join(day("entry"), ["symbol", "entry_date"], "left").join(day("exit"), ["symbol", "exit_date"], "left")

    def outside(price: str, prefix: str) -> Column:
        low, high = F.col(f"__{prefix}_low") - slack, F.col(f"__{prefix}_high") + slack
        return ~F.coalesce(F.col(price).between(low, high), F.lit(False))

    expected = (F.col("last_close") / F.col("entry") - 1) * 100 - config.COST_PCT
    drifted = (F.col("status") == "holding") & (F.abs(expected - F.col("ret")) > 0.05)
    faults = F.array(
        F.when(outside("entry", "entry"), "buy"),
        F.when(F.col("exit_date").isNotNull() & outside("exit", "exit"), "sell"),
        F.when(F.col("exit_date").isNull() & F.coalesce(drifted, F.lit(False)), "return"),
    )
    return both.select("scanner", "symbol", "hit_date", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def check(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))


def checks(
    states: DataFrame, bars: DataFrame, members: DataFrame, cache: DataFrame, now: Column, max_age_hours: int = 80
) -> DataFrame:
    """Scan freshness, stale holdings, price mismatches and fundamentals coverage, each one row, and all together."""
    scan = members.agg(F.max("run_at").alias("at"), F.count(F.lit(1)).alias("n"))
    age = dates.age_hours(now, F.col("at"))
    fresh = check(
        scan, "scan", (age < max_age_hours) & (F.col("n") > 0), F.concat(F.format_string("%.0f", age), F.lit(" h old"))
    )
    held = states.where(F.col("status") == "holding").groupBy("symbol").agg(F.max("last_date").alias("last_date"))
    newest = held.agg(F.max("last_date").alias("newest"))
    late = held.transform(beside, newest).agg(
        F.count_if(F.col("last_date") != F.col("newest")).alias("late"), F.count(F.lit(1)).alias("held")
    )
    stale = check(late, "prices", F.col("late") == 0, F.concat(F.col("late"), F.lit(" of "), F.col("held"), F.lit(" behind")))
    faults = price_mismatches(states, bars).agg(F.count(F.lit(1)).alias("bad"))
    match = check(faults, "trades", F.col("bad") == 0, F.concat(F.col("bad"), F.lit(" mismatches")))
    wanted = states.select("symbol").distinct().join(cache.select("symbol", "fetched_at"), "symbol", "left")
    cover = wanted.agg(
        F.count("fetched_at").alias("have"), F.count(F.lit(1)).alias("all"), F.min("fetched_at").alias("oldest")
    )
    days = F.datediff(now, F.col("oldest"))
    known = check(
        cover, "fundamentals", (F.col("have") >= 0.8 * F.col("all")) & (days <= 45),
        F.concat(F.col("have"), F.lit("/"), F.col("all"), F.lit(", oldest "), days, F.lit(" days")),
    )
    rows = fresh.unionByName(stale).unionByName(match).unionByName(known)
    overall = rows.agg(F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("n"))
    return rows.unionByName(overall.select(F.lit("overall").alias("name"), "ok", F.concat(F.col("n"), F.lit(" failed")).alias("detail")))

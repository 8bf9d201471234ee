"""Live state of every signal, and the lists read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from ..functions.numbers import round_binary, truncated
from ..functions.rules import RuleBook
from ..operators import asof, outcomes
from ..operators import signals as sig
from ..operators.keys import latest_values, pick_per_key

TRADE_FIELDS = [
    "entry_pos", "entry_date", "entry", "gap", "stop", "exit", "exit_date", "sell_signal", "now", "ma", "sessions_left", "ret",
]


def signal_states(signals: DataFrame, measured: DataFrame, hits: DataFrame, rules: RuleBook) -> DataFrame:
    """Each signal's state before slots: bar, filter, touch, barrier, duplicates, confirmations and tier.

    `measured` are bars with the filter measures.
    """
    base = signals.drop("tier", "sector")
    snapped = asof.snap_to_session(base, measured.select("symbol", "date"))
    located = sig.locate(snapped, measured, rules, ["filter_dist", "filter_atr"], day="session_date")
    args = (F.col("scanner"), F.col("filter_dist"), F.col("filter_atr"))
    passed = F.col("end_pos").isNull() | rules.passes(*args)
    cleared = {c: F.when(passed, F.col(c)) for c in ("entry_pos", "entry_date", "entry", "gap")}
    touched = outcomes.first_touch(located, rules).withColumns(cleared).drop("session_date", "weekly", "start_pos")
    # Every signal goes through the search once, and takes on tier and confirmations after it.
    ridden = outcomes.barrier_exit(touched, measured, rules, every=True)
    joined = sig.confirmations(sig.with_tier(ridden, hits))
    status = F.when(F.col("end_pos").isNull(), "no prices yet").when(~passed, "skipped").otherwise(F.col("status"))
    window = rules.value(F.col("scanner"), "window")
    states = joined.withColumns(
        {
            "status": status,
            "why": F.when(~passed, rules.skip_reason(*args)),
            "sessions_left": F.when(passed, F.col("sessions_left")),
            "valid_until": F.when(
                status == "waiting",
                dates.add_workdays(F.col("signal_date"), window),
            ),
        }
    )
    marked = sig.mark_duplicates(states)
    again = F.col("duplicate")
    gone = {c: F.when(~again, F.col(c)) for c in [*TRADE_FIELDS, "trigger", "valid_until", "last_close", "last_date"]}
    return marked.withColumns(
        gone
        | {
            "status": F.when(again, "duplicate").otherwise(F.col("status")),
            "why": F.when(again, "a buy-stop from an earlier signal is still open").otherwise(F.col("why")),
        }
    ).drop("duplicate")


def is_closed() -> Column:
    return F.col("status").isin(config.CLOSED_STATUSES)


def book_summary(states: DataFrame) -> DataFrame:
    """Signals, open orders, holdings, closed trades, win share and profit: per scanner and for all."""
    closed, holding = is_closed(), F.col("status") == "holding"
    # Returns carry two decimals, so profit on the stake adds up in whole units.
    profit = F.round(F.col("ret") / 100 * config.STAKE).cast("long")
    total = states.rollup("scanner").agg(
        F.count_if(F.col("status") != "duplicate").alias("signals"), F.count_if(F.col("status") == "waiting").alias("watching"),
        F.count_if(holding).alias("holding"), F.count_if(closed).alias("closed"),
        F.count_if(closed & (F.col("ret") > 0)).alias("__won"),
        F.coalesce(F.sum(F.when(closed, profit)), F.lit(0)).alias("pnl"),
        F.coalesce(F.sum(F.when(holding, profit)), F.lit(0)).alias("open_pnl"),
    )
    return total.select(
        F.coalesce("scanner", F.lit("All scanners")).alias("scanner"), "signals", "watching", "holding", "closed",
        F.round(100.0 * F.col("__won") / F.nullif("closed", F.lit(0))).cast("long").alias("win"), "pnl", "open_pnl",
    )


def event_feed(states: DataFrame, today: Column, days: int = config.ALERT_DAYS) -> DataFrame:
    """Events with a key that names them once for ever: setup, bought, sell and exit."""
    since = F.date_sub(today, days)
    held = states.where(F.col("status") == "holding").select("symbol").distinct().withColumn("__held", F.lit(True))
    known = states.join(held, "symbol", "left")
    kinds = F.array(
        F.when((F.col("status") == "waiting") & F.col("__held").isNull(), F.struct(F.lit("setup").alias("tag"), F.lit("setup").alias("kind"))),
        F.when(F.col("entry_date") >= since, F.struct(F.lit("bought").alias("tag"), F.lit("bought").alias("kind"))),
        F.when(F.col("sell_signal") >= since, F.struct(F.lit("sell").alias("tag"), F.lit("sell").alias("kind"))),
        F.when(is_closed() & (F.col("exit_date") >= since), F.struct(F.lit("exit").alias("tag"), F.col("status").alias("kind"))),
    )
    found = known.select(*sig.KEY, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    key = F.concat_ws("|", "scanner", F.col("symbol").cast("string"), F.col("hit_date").cast("string"), "k.tag")
    return found.select(key.alias("key"), *sig.KEY, "k.kind")


def outcome_text(states: DataFrame) -> DataFrame:
    """What became of each signal in words; `latest` marks the newest signal of a scanner and symbol."""
    held = latest_values(
        states.where(F.col("status") == "holding"), ["symbol"], ["hit_date", "scanner"], ["scanner", "ret"]
    ).select("symbol", F.col("scanner").alias("__by"), F.col("ret").alias("__ret"))

    def signed(c: str) -> Column:
        return F.concat(F.format_string("%+.1f", round_binary(F.col(c), 1)), F.lit("%"))

    sold = F.when(F.col("status") == "stop", "stop-loss").when(
        F.col("status") == "average", f"below {config.EXIT_SPAN}-day EMA"
    ).otherwise(F.col("status"))
    words = (
        F.when(F.col("__by") == F.col("scanner"), F.concat(F.lit("holding "), signed("__ret")))
        .when(F.col("__by").isNotNull(), F.concat(F.lit("holding (from "), F.col("__by"), F.lit(")")))
        .when(is_closed(), F.concat(F.lit("bought, sold "), signed("ret"), F.lit(" ("), sold, F.lit(")")))
        .when(
            F.col("status") == "no slot",
            F.when(F.col("why").contains("holding"), "crossed, but already holding").otherwise("crossed, but no free slot"),
        )
        .when(F.col("status") == "skipped", F.concat(F.lit("skipped: "), F.split("why", ":").getItem(0)))
        .when(F.col("status") == "waiting", "buy-stop open")
        .when(F.col("status") == "no breakout", "didn't cross in time")
        .when(F.col("status") == "no prices yet", "new: buy-stop after the close")
    )
    told = states.where(F.col("status") != "duplicate").join(held, "symbol", "left").select(*sig.KEY, words.alias("outcome"))
    told = told.where(F.col("outcome").isNotNull())
    newest = F.max("hit_date").over(W.partitionBy("scanner", "symbol"))
    return told.withColumn("latest", F.col("hit_date") == newest)


def held_symbols(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") == "holding").select("symbol").distinct()


def open_orders(states: DataFrame) -> DataFrame:
    """Newest open order per symbol that is not held, in the order slots are given."""
    waiting = states.where(F.col("status") == "waiting").join(held_symbols(states), "symbol", "left_anti")
    return pick_per_key(waiting, ["symbol"], [F.desc("hit_date"), F.col("scanner")])


def holdings(states: DataFrame) -> DataFrame:
    """Open trades with working days held, profit and value on the stake."""
    rows = states.where(F.col("status") == "holding")
    return rows.withColumns(
        {
            "days": dates.workdays_held(F.col("entry_date"), F.col("last_date")),
            "pnl": truncated(F.round(F.col("ret") / 100 * config.STAKE, 4)),
            "value": truncated(F.round(config.STAKE * (1 + F.col("ret") / 100), 4)),
        }
    )


def sold(states: DataFrame) -> DataFrame:
    """Closed trades with working days held and profit on the stake."""
    return states.where(is_closed()).withColumns(
        {
            "days": dates.workdays_held(F.col("entry_date"), F.col("exit_date")),
            "pnl": truncated(F.round(F.col("ret") / 100 * config.STAKE, 4)),
        }
    )


def passed_over(states: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Latest recent signal per scanner and symbol that was not taken, for symbols not active."""
    active = states.where(F.col("status").isin("waiting", "holding")).select("symbol").distinct()
    rows = states.where(
        F.col("status").isin("no slot", "skipped") & (F.col("hit_date") >= F.date_sub(today, days))
    ).join(active, "symbol", "left_anti")
    why = F.when(F.col("status") == "no slot", "no free slot").otherwise(F.coalesce("why", F.lit("filtered out")))
    latest = pick_per_key(rows, ["scanner", "symbol"], [F.desc("hit_date")])
    return latest.select(*sig.KEY, why.alias("why"))


def to_do(states: DataFrame, today: Column, days: int = config.ALERT_DAYS) -> DataFrame:
    """Actions now: sell flagged holdings, keep orders open, note fresh buys."""
    held = states.where(F.col("status") == "holding")
    flagged = F.col("sell_signal").isNotNull()
    sells = held.where(flagged).select(F.lit("sell").alias("action"), *sig.KEY)
    orders = open_orders(states).select(F.lit("order").alias("action"), *sig.KEY)
    fresh = held.where(~flagged & (F.col("entry_date") >= F.date_sub(today, days))).select(F.lit("bought").alias("action"), *sig.KEY)
    return sells.unionByName(orders).unionByName(fresh)

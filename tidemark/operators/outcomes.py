"""What happened after a signal: entry touch, first barrier, holding returns.

Sessions are `pos` arithmetic. Everything an outcome needs from later bars is put on
the bar row by ordered windows, so a signal reads it with one equality join. The stop
search goes down a tree of minima: one row per level and entry, however long the path.
A bar opens at or above its low, so an open under the stop is a low under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from ..functions.numbers import net_return, round_scaled, with_rounded
from ..functions.rules import RuleBook
from .bars import by_pos
from .indicators import exit_line
from . import rangemin
from .rolling import Extreme, sliding_extremes
from .signals import KEY, locate

CHUNK = 32


def first_touch(located: DataFrame, rules: RuleBook) -> DataFrame:
    """Add the first session of the entry window whose high passes the trigger, its fill and the status."""
    window = rules.value(F.col("scanner"), "window")
    step = F.lit(None).cast("int")
    for k in range(rules.longest_window(), 0, -1):
        high = F.col("upcoming").getItem(k - 1)["high"]
        step = F.when((window >= k) & (high > F.col("trigger")), F.lit(k)).otherwise(step)
    after = F.col("n_bars") - 1 - F.col("end_pos")
    bar = F.element_at("upcoming", F.col("__step"))
    return (
        located.withColumns({"__step": step, "__window": window, "__after": after})
        .withColumns(
            {
                "entry_pos": F.col("end_pos") + F.col("__step"),
                "entry_date": F.when(F.col("__step").isNotNull(), bar["date"]),
                "entry": F.when(F.col("__step").isNotNull(), F.greatest(bar["open"], F.col("trigger"))),
                "gap": F.when(F.col("__step").isNotNull(), bar["open"] > F.col("trigger")),
                "status": F.when(F.col("end_pos").isNull(), "no bar")
                .when(F.col("__step").isNotNull(), "touched")
                .when(F.col("__after") < F.col("__window"), "waiting")
                .otherwise("no breakout"),
                "sessions_left": F.when(
                    F.col("end_pos").isNotNull() & F.col("__step").isNull(),
                    F.greatest(F.col("__window") - F.col("__after"), F.lit(0)),
                ),
            }
        )
        .drop("__step", "__window", "__after", "upcoming")
    )


def path_bars(bars: DataFrame, rules: RuleBook, span: int = config.EXIT_SPAN) -> DataFrame:
    """Bars with what an entry on them needs: next close below the line, holding-limit bars, last bar.

    All are read in one order, from the last session to the first (`__back`, the negative `pos`): narrow rows are sorted
    for it once, and a join on (symbol, __back) takes the wide rows as they lie.
    """
    lined = exit_line(bars, span).withColumn("__back", -F.col("pos"))
    by_back = W.partitionBy("symbol").orderBy("__back")
    lined = lined.withColumn(
        "__next", F.struct(F.lag("open", 1).over(by_back).alias("open"), F.lag("date", 1).over(by_back).alias("date"))
    )
    below = F.when(
        F.col("close") < F.col("ema"),
        F.struct(
            F.col("pos"), F.col("date"), F.col("close"), F.col("ema"), F.col("__next.open").alias("exit"),
            F.col("__next.date").alias("exit_date"),
        ),
    )
    later = by_back.rowsBetween(W.unboundedPreceding, -1)
    caps = {
        f"cap_{h}": F.struct(F.lag("date", h).over(by_back).alias("date"), F.lag("close", h).over(by_back).alias("close"))
        for h in rules.holds()
    }
    end = F.first(F.struct("date", "close", "ema")).over(by_back)
    return lined.withColumns({"below": F.last(below, ignorenulls=True).over(later), "end": end} | caps).drop("__next")


def _cap_bar(rules: RuleBook, hold: Column) -> Column:
    out = None
    for h in rules.holds():
        out = F.when(hold == h, F.col(f"cap_{h}")) if out is None else out.when(hold == h, F.col(f"cap_{h}"))
    return out


def barrier_exit(touched: DataFrame, bars: DataFrame, rules: RuleBook, every: bool = False) -> DataFrame:
    """Close every touched signal at its first barrier: stop, close below the line, holding limit.

    The stop wins when both fall on one bar. A close below the line sells at the next open,
    or flags a sale when there is no next bar. With `every`, signals without an entry stay as they are.
    """
    paths = path_bars(bars, rules)
    hold = rules.value(F.col("scanner"), "max_hold")
    at = paths.select("symbol", "__back", "below", "end", *[f"cap_{h}" for h in rules.holds()])
    limit = F.col("entry_pos") + hold
    last = F.col("n_bars") - 1
    entries = (
        (touched if every else touched.where(F.col("entry_pos").isNotNull()))
        .withColumn("__back", -F.col("entry_pos"))
        .join(at, ["symbol", "__back"], "left" if every else "inner")
        .withColumns({"__cap": _cap_bar(rules, hold), "__fell": F.col("below.pos") <= limit})
    )
    fell = F.coalesce("__fell", F.lit(False))
    kind = (
        F.when(fell & F.col("below.exit").isNotNull(), "average")
        .when(fell, "sell flag")
        .when(limit <= last, "time")
        .when(F.col("entry_pos").isNotNull(), "holding")
    )
    entries = entries.withColumn("__kind", kind)
    flagged, held = F.col("__kind") == "sell flag", F.col("__kind") == "holding"
    # What happens without a stop, as plain columns: the search carries these and no structs.
    plain = entries.withColumns(
        {
            "stop": F.col("entry") * (1 - rules.value(F.col("scanner"), "stop_pct") / 100),
            "status": F.when(flagged | held, "holding").otherwise(F.coalesce("__kind", "status")),
            "exit": F.when(F.col("__kind") == "average", F.col("below.exit")).when(F.col("__kind") == "time", F.col("__cap.close")),
            "exit_date": F.when(F.col("__kind") == "average", F.col("below.exit_date")).when(
                F.col("__kind") == "time", F.col("__cap.date")
            ),
            "sell_signal": F.when(flagged, F.col("below.date")),
            "now": F.when(flagged, F.col("below.close")).when(held, F.col("end.close")),
            "ma": F.when(flagged | (F.col("__kind") == "average"), F.col("below.ema")).when(held, F.col("end.ema")),
            "sessions_left": F.when(F.col("__kind").isNull(), F.col("sessions_left")).when(flagged, F.lit(1)).when(held, limit - last),
            "last_close": F.col("end.close"),
            "last_date": F.col("end.date"),
            "__until": F.least(F.col("below.pos"), limit, last),
        }
    ).drop("__kind", "__cap", "__fell", "__back", "below", "end", *[f"cap_{h}" for h in rules.holds()])
    # One number: the sessions of the longest history.
    longest = bars.agg(F.max("n_bars")).first()[0] or 1
    found = rangemin.first_under(plain, bars, "low", ["open", "date"], "entry_pos", "__until", "stop", longest, "__hit")
    stopped = F.col("__hit").isNotNull()
    opens_below = (F.col("__hit.pos") > F.col("entry_pos")) & (F.col("__hit.open") <= F.col("stop"))
    out = found.withColumns(
        {
            "status": F.when(stopped, "stop").otherwise(F.col("status")),
            "exit": F.when(stopped, F.when(opens_below, F.col("__hit.open")).otherwise(F.col("stop"))).otherwise(F.col("exit")),
            "exit_date": F.when(stopped, F.col("__hit.date")).otherwise(F.col("exit_date")),
        }
        | {c: F.when(~stopped, F.col(c)) for c in ("sell_signal", "now", "ma", "sessions_left")}
    )
    ret = net_return(F.col("entry"), F.coalesce("exit", "now"), config.COST_PCT)
    return with_rounded(out.withColumn("ret", ret), {"ret": 2}).drop("__until", "__hit")


def closed_trades(signals: DataFrame, bars: DataFrame, rules: RuleBook, extra: list[str] | None = None) -> DataFrame:
    """Closed trades under the rules: filter, touch, barrier; `bars` carries the filter measures."""
    kept = ["filter_dist", "filter_atr", *(extra or [])]
    located = locate(signals, bars, rules, kept)
    passed = located.where(
        F.col("end_pos").isNotNull() & rules.passes(F.col("scanner"), F.col("filter_dist"), F.col("filter_atr"))
    )
    # The stop search carries every column it is given; these have served.
    touched = first_touch(passed, rules).drop("weekly", "start_pos", "signal_date", "bar_low", "bar_close", "gap")
    done = barrier_exit(touched, bars, rules).where(F.col("status").isin(config.CLOSED_STATUSES))
    return done.withColumn("days", dates.workdays_held(F.col("entry_date"), F.col("exit_date")))


def horizon_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with, per horizon n: the close n sessions on, best and worst close until then, the index then."""
    marked = bars.join(
        calendar.select("date", F.col("close").alias("__idx"), F.col("close_before").alias("index_start")), "date", "left"
    )
    lengths = [n for _, n in config.HORIZONS]
    specs = [Extreme("close", op, n + 1, f"{name}_{n}") for n in lengths for op, name in (("max", "best"), ("min", "worst"))]
    spread = sliding_extremes(marked, specs, ["symbol"], "pos", ahead=True)
    return spread.withColumns(
        {f"close_{n}": F.lead("close", n).over(by_pos()) for n in lengths}
        | {f"index_{n}": F.lead("__idx", n).over(by_pos()) for n in lengths}
    ).drop("__idx")


def hold_outcomes(signals: DataFrame, bars: DataFrame, calendar: DataFrame, rules: RuleBook) -> DataFrame:
    """Buy-and-hold result of each signal, one row per signal and reached horizon; others keep one row."""
    touched = first_touch(locate(signals, bars, rules), rules).withColumn(
        "status",
        F.when(F.col("status") == "touched", "bought")
        .when(F.col("status") == "waiting", "pending")
        .when(F.col("status") == "no bar", "no_price_data")
        .otherwise("not_triggered"),
    )
    later = horizon_bars(bars, calendar)
    lengths = [n for _, n in config.HORIZONS]
    reach = F.array(
        *[
            F.struct(
                F.lit(key).alias("horizon"), F.lit(n).alias("n"), F.col(f"close_{n}").alias("close"),
                F.col(f"best_{n}").alias("best"), F.col(f"worst_{n}").alias("worst"), F.col(f"index_{n}").alias("idx"),
            )
            for key, n in config.HORIZONS
        ]
    )
    reached = F.filter(reach, lambda h: h["close"].isNotNull())
    at = later.select("symbol", F.col("pos").alias("entry_pos"), "index_start", reached.alias("__reached"))
    joined = touched.join(at, ["symbol", "entry_pos"], "left")
    rows = joined.select("*", F.explode_outer("__reached").alias("h"))

    def move(c: str) -> Column:
        return (F.col(f"h.{c}") / F.col("entry") - 1) * 100

    return rows.select(
        *KEY,
        *[c for c in ("tier", "sector", "source") if c in signals.columns],
        "status", "trigger", "entry_date", "entry", F.col("h.horizon").alias("horizon"),
        *[round_scaled(move(c), 2).alias(n) for c, n in (("close", "ret"), ("best", "best"), ("worst", "worst"))],
        round_scaled((F.col("h.idx") / F.col("index_start") - 1) * 100, 2).alias("index_ret"),
    )


def trade_paths(trades: DataFrame, lined: DataFrame, before: int = 10, after: int = 3) -> DataFrame:
    """Closes and exit line from `before` sessions ahead of the signal to `after` beyond the exit.

    `lined` are bars with `ema`. Paths are cut into chunks of positions, so the join keeps an equality key.
    """
    exits = lined.select("symbol", F.col("date").alias("exit_date"), F.col("pos").alias("__exit_pos"))
    span = trades.join(exits, ["symbol", "exit_date"], "left").withColumns(
        {
            "__a": F.greatest(F.col("end_pos") - before, F.lit(0)),
            "__z": F.least(F.coalesce(F.col("__exit_pos") + after, F.col("n_bars") - 1), F.col("n_bars") - 1),
        }
    )
    pieces = span.select(
        *KEY, "__a", "__z", F.explode(F.sequence(F.floor(F.col("__a") / CHUNK), F.floor(F.col("__z") / CHUNK))).alias("__chunk")
    )
    rows = lined.select("symbol", F.floor(F.col("pos") / CHUNK).alias("__chunk"), "pos", "date", "close", "ema")
    return (
        pieces.join(rows, ["symbol", "__chunk"])
        .where(F.col("pos").between(F.col("__a"), F.col("__z")))
        .select(*KEY, "pos", "date", "close", "ema")
    )

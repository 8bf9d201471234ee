"""Dashboard tables: breakouts, scanners, digest and sectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions.numbers import bound, pct_change, round_binary
from ..operators.keys import earliest_values, latest_values, pick_per_key


def cents(price: Column) -> Column:
    return round_binary(price, 2)


def change(base: Column, value: Column) -> Column:
    return round_binary(pct_change(base, value), 2)


def buy_or_hold(chg: Column) -> Column:
    return F.when(chg > 0, "BUY").otherwise("HOLD")


def since_event(events: DataFrame, bars: DataFrame, day: str = "day") -> DataFrame:
    """Add what followed each event: the last close and its date, and high, low and count of later sessions.

    Events and bars are laid out newest first per symbol, so that running extremes at an
    event hold its later bars; no event meets every bar in a join.
    """
    left = events.select("*", F.col(day).alias("__d"), F.lit(0).alias("__kind"))
    right = bars.select(
        "symbol", F.col("date").alias("__d"), F.lit(1).alias("__kind"), F.col("high").alias("__h"), F.col("low").alias("__l"),
        F.col("close").alias("__c"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    later = W.partitionBy("symbol").orderBy(F.desc("__d"), "__kind").rowsBetween(W.unboundedPreceding, 0)
    of_symbol = W.partitionBy("symbol")
    bar_day = F.when(F.col("__kind") == 1, F.col("__d"))
    both = both.withColumns(
        {
            "best": F.max("__h").over(later), "worst": F.min("__l").over(later),
            "days": F.count(bar_day).over(later), "last_date": F.max(bar_day).over(of_symbol),
            "last_close": F.max_by("__c", bar_day).over(of_symbol),
        }
    )
    followed = F.col("last_date") >= F.col("__d")
    return both.where(F.col("__kind") == 0).withColumns(
        {c: F.when(followed, F.col(c)) for c in ("best", "worst", "days", "last_date", "last_close")}
    ).drop("__d", "__kind", "__h", "__l", "__c")


def breakouts(events: DataFrame, bars: DataFrame, latest: DataFrame, on_scan: DataFrame) -> DataFrame:
    """Each entry event with the price now, best and worst since, and whether it is still on the scanner.

    `events`: scanner, symbol, run, day, kind, trigger. `latest`: scanner, symbol, price of the last scan row.
    """
    now_rows = latest.select("scanner", "symbol", F.col("price").alias("__scan"))
    flags = on_scan.select("scanner", "symbol", F.lit(True).alias("__on"))
    told = since_event(events, bars)
    joined = told.join(now_rows, ["scanner", "symbol"], "left").join(flags, ["scanner", "symbol"], "left")
    now = F.when(F.col("last_date").isNotNull(), bound(F.col("last_close"), cents)).otherwise(F.col("__scan"))
    chg = change(F.col("trigger"), F.col("now"))
    return joined.withColumn("now", now).select(
        "scanner", "symbol", "run", "kind", "day", "trigger", "now", F.col("last_date").alias("now_date"), chg.alias("chg"),
        change(F.col("trigger"), F.col("best")).alias("best_chg"), change(F.col("trigger"), F.col("worst")).alias("worst_chg"),
        "days", F.coalesce("__on", F.lit(False)).alias("on_scan"), buy_or_hold(chg).alias("status"),
    )


def own_triggers(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Replace a breakout's trigger by its own signal's, found by exact day, else by the latest signal."""
    known = states.where(F.col("trigger").isNotNull())
    exact = known.select("scanner", "symbol", F.col("hit_date").alias("day"), F.col("trigger").alias("__exact"))
    newest = latest_values(known, ["scanner", "symbol"], ["hit_date"], ["trigger"]).withColumnRenamed("trigger", "__newest")
    joined = rows.join(exact, ["scanner", "symbol", "day"], "left").join(newest, ["scanner", "symbol"], "left")
    trigger = F.coalesce(bound(F.coalesce("__exact", "__newest"), cents), F.col("trigger"))
    chg = change(F.col("trigger"), F.col("now"))
    return joined.withColumn("trigger", trigger).withColumn("chg", chg).withColumn("status", buy_or_hold(chg)).drop(
        "__exact", "__newest"
    )


def breakout_stats(rows: DataFrame) -> DataFrame:
    """Per scanner: events with a change, how many are above the trigger, mean change and mean best."""
    return rows.where(F.col("chg").isNotNull()).groupBy("scanner").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("chg") > 0).alias("above"),
        (F.sum(F.round(F.col("chg") * 100).cast("long")) / F.count("chg") / 100).alias("avg_chg"),
        (F.sum(F.round(F.col("best_chg") * 100).cast("long")) / F.count("best_chg") / 100).alias("avg_best"),
    )


def scanner_view(current: DataFrame, triggers: DataFrame) -> DataFrame:
    """Members of the latest run with their trigger and change, best first, unknown last."""
    joined = current.join(triggers.select("scanner", "symbol", "trigger", "seen_at"), ["scanner", "symbol"], "left")
    chg = change(F.col("trigger"), F.col("price"))
    return joined.select(
        "scanner", "symbol", F.col("price").alias("now"), "trigger", F.to_date("seen_at").alias("trigger_date"),
        chg.alias("chg"), buy_or_hold(chg).alias("status"),
    ).orderBy("scanner", F.desc_nulls_last("chg"), "symbol")


def digest(events: DataFrame, bars: DataFrame, latest: DataFrame, on_scan: DataFrame) -> DataFrame:
    """Latest event per scanner and symbol: scan price while still listed, else the last daily close since."""
    newest = latest_values(events, ["scanner", "symbol"], ["run"], ["run", "day", "kind", "trigger"])
    rows = breakouts(newest, bars, latest, on_scan)
    scan = latest.select("scanner", "symbol", F.col("price").alias("__scan"))
    now = F.when(F.col("on_scan"), F.col("__scan")).otherwise(F.coalesce(F.col("now"), F.col("__scan")))
    priced = rows.join(scan, ["scanner", "symbol"], "left").withColumn("now", now)
    chg = change(F.col("trigger"), F.col("now"))
    return priced.select(
        "scanner", buy_or_hold(chg).alias("group"), "symbol", "trigger", "now", chg.alias("chg"), (~F.col("on_scan")).alias("off_scan")
    ).orderBy("scanner", "group", F.desc_nulls_last("chg"), "symbol")


def sector_counts(hits: DataFrame, since: Column, top: int = 5) -> DataFrame:
    """The sectors with most hits since a day per scanner; ties by name."""
    counted = hits.where(F.col("hit_date") >= since).groupBy("scanner", "sector").agg(F.count(F.lit(1)).alias("n"))
    return pick_per_key(counted, ["scanner"], [F.desc("n"), F.col("sector")], top)


def sector_windows(hits: DataFrame, today: Column, days: tuple[int, int] = (7, 30), top: int = 5, cut: bool = True) -> DataFrame:
    """Short- and long-window counts per scanner and sector, the top by long, short, name.

    With `cut`, a sector outside a window's own top shows 0 there.
    """
    short, long = F.date_sub(today, days[0]), F.date_sub(today, days[1])
    counted = hits.where(F.col("hit_date") >= long).groupBy("scanner", "sector").agg(
        F.count_if(F.col("hit_date") >= short).alias("short"), F.count(F.lit(1)).alias("long")
    )
    if cut:
        places = {
            c: F.row_number().over(W.partitionBy("scanner").orderBy(F.desc(c), "sector")) for c in ("short", "long")
        }
        placed = counted.withColumns({f"__{c}": p for c, p in places.items()})
        counted = placed.select(
            "scanner", "sector", *[F.when(F.col(f"__{c}") <= top, F.col(c)).otherwise(0).alias(c) for c in ("short", "long")]
        ).where((F.col("short") > 0) | (F.col("long") > 0))
    return pick_per_key(counted, ["scanner"], [F.desc("long"), F.desc("short"), F.col("sector")], top)


def sector_momentum(
    picks: DataFrame, bars: DataFrame, today: Column, window: int = 14, weeks: int = 8
) -> DataFrame:
    """Symbols picked per sector in the last window and the one before, weekly counts, agreement and moves.

    `picks`: day, scanner, symbol, sector, ref (price at the pick, NULL to use that day's close).
    Picks are folded per (sector, symbol) first, so a sector that holds much of the table is
    spread over its symbols, and distinct counts become plain sums.
    """
    start = F.date_sub(today, 7 * weeks - 1)
    cur_from, prev_from = F.date_sub(today, window - 1), F.date_sub(today, 2 * window - 1)
    named = picks.where(F.col("day") >= start).withColumn(
        "sector", F.coalesce(F.nullif("sector", F.lit("")), F.lit(config.UNCLASSIFIED))
    )
    week = F.least(F.floor(F.datediff("day", start) / 7), F.lit(weeks - 1)).cast("int")
    is_cur = F.col("day") >= cur_from
    at = F.struct("day", "scanner")
    folded = named.groupBy("sector", "symbol").agg(
        F.max(is_cur.cast("int")).alias("cur"),
        F.max(((F.col("day") >= prev_from) & ~is_cur).cast("int")).alias("prev"),
        F.bit_or(F.pow(F.lit(2), week).cast("int")).alias("weeks"),
        F.min(F.when(F.col("day") >= prev_from, F.struct("day", "scanner", "ref"))).alias("first"),
        F.max(F.when(is_cur, at)).alias("newest"),
    )
    closes = bars.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
    on_day = bars.select("symbol", F.col("date").alias("__day"), F.col("close").alias("__close"))
    priced = (
        folded.withColumn("__day", F.col("first.day"))
        .join(on_day, ["symbol", "__day"], "left")
        .join(closes, "symbol", "left")
    )
    move = F.when(
        F.col("last_date") >= F.col("__day"), change(F.coalesce("first.ref", "__close"), F.col("last_close"))
    )
    moved = priced.withColumn("move", move)
    per_sector = moved.groupBy("sector").agg(
        F.sum("cur").alias("cur"), F.sum("prev").alias("prev"),
        (F.sum(F.round(F.col("move") * 100).cast("long")) / F.count("move") / 100).alias("avg_move"),
        F.count("move").alias("moves_n"),
        *[F.sum(F.getbit("weeks", F.lit(i)).cast("int")).alias(f"__w{i}") for i in range(weeks)],
    ).where((F.col("cur") > 0) | (F.col("prev") > 0))
    # Scanners are few; the set per sector is bounded by their number.
    agreeing = named.where(is_cur).groupBy("sector").agg(F.array_sort(F.collect_set("scanner")).alias("scanners"))
    fresh = moved.where("cur = 1").select("sector", "symbol", "newest")
    six = pick_per_key(fresh, ["sector"], [F.desc("newest"), F.desc("symbol")], 6)
    recent = six.groupBy("sector").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("newest", "symbol")), asc=False), lambda s: s["symbol"].cast("string")
        ).alias("recent")
    )
    empty = F.array().cast("array<string>")
    return (
        per_sector.withColumn("weekly", F.array(*[F.col(f"__w{i}") for i in range(weeks)]))
        .drop(*[f"__w{i}" for i in range(weeks)])
        .join(agreeing, "sector", "left")
        .join(recent, "sector", "left")
        .withColumns({"scanners": F.coalesce("scanners", empty), "recent": F.coalesce("recent", empty)})
        .orderBy(F.desc("cur"), F.desc(F.col("cur") - F.col("prev")), "sector")
    )


def top_movers(momentum: DataFrame, n: int = 3) -> DataFrame:
    """The sectors that gained and lost most picks between the two windows."""
    diff = F.col("cur") - F.col("prev")
    rows = momentum.where(F.lower("sector") != config.UNCLASSIFIED.lower()).select("sector", diff.alias("diff"))
    up = rows.where("diff > 0").orderBy(F.desc("diff"), "sector").limit(n).withColumn("side", F.lit("up"))
    down = rows.where("diff < 0").orderBy("diff", "sector").limit(n).withColumn("side", F.lit("down"))
    return up.unionByName(down)


def calendar_sources(symbols: DataFrame, calendar: DataFrame) -> list[DataFrame]:
    """Calendar days of symbols by short name, by the symbol as code, and by the code that the symbol is mapped to.

    `symbols`: symbol, mapped (may be NULL); `calendar`: short_name, code, day. `what` tells how a day was found.
    """
    def found(on: str, by: str, what: str) -> DataFrame:
        rows = calendar.select(F.col(by).alias(on), "day")
        return symbols.join(rows, on).select("symbol", "day", F.lit(what).alias("what"))

    return [found("symbol", "short_name", "name"), found("symbol", "code", "code"), found("mapped", "code", "mapped code")]


def first_event_dates(symbols: DataFrame, sources: list[DataFrame], start: Column, end: Column) -> DataFrame:
    """Event day per symbol from the first source that has one in the window.

    Each source: symbol, day, what. Within a source the earliest day wins, then `what`.
    """
    both = None
    for i, source in enumerate(sources):
        tagged = source.where(F.col("day").between(start, end)).select("symbol", "day", "what", F.lit(i).alias("prio"))
        both = tagged if both is None else both.unionByName(tagged)
    first = earliest_values(both, ["symbol"], ["prio"], ["day", "what"])
    return symbols.select("symbol").distinct().join(first, "symbol")

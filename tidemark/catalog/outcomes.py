"""Signals, touches, exits, holding returns and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from ..functions.rules import tier_priority
from ..operators import asof, indicators, outcomes
from ..operators import signals as sig
from ..operators.keys import pick_per_key
from ..plans import summaries
from ..sources import standin
from .base import query, with_views
from .market import rounded

RULES = standin.RULES


def sources_of(spark, sf):
    """Two hit sources: exports first, then hits dated by order day."""
    exported = standin.hits(spark, sf).withColumn("source", F.lit("backtest"))
    live = standin.hits(spark, sf, "o_orderdate").withColumn("source", F.lit("live"))
    return [exported, live]


def closed(spark, sf, told=("tier", "sector")):
    """Closed trades; `told` are the columns besides the key that signals carry through every step."""
    bars = standin.bar_table(spark, sf)
    measured = indicators.filter_measures(bars)
    return outcomes.closed_trades(standin.signals(spark, sf).select(*sig.KEY, *told), measured, RULES)


def holds(spark, sf):
    bars = standin.bar_table(spark, sf)
    calendar = asof.filled_calendar(standin.index_bars(bars), ["close"])
    return outcomes.hold_outcomes(standin.signals(spark, sf), bars, calendar, RULES)


HITS2 = {
    "hits2": ([], """
        SELECT o_orderpriority AS scanner, l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS hit_date,
               first(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Largecap' WHEN 'BUILDING' THEN 'Midcap'
                     WHEN 'FURNITURE' THEN 'Smallcap' ELSE '' END ORDER BY l_orderkey, l_partkey) AS tier,
               first(p_type ORDER BY l_orderkey, l_partkey) AS sector
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN part ON l_partkey = p_partkey
        GROUP BY ALL"""),
}


@query("signals_union", "U1 U2 S15 F7", with_views("hits1 hits2 rules", """
SELECT scanner, symbol, hit_date, tier, sector, source FROM (
    SELECT *, row_number() OVER (PARTITION BY scanner, symbol, slot ORDER BY src, hit_date) AS n
    FROM (SELECT u.*, CASE WHEN r.weekly THEN CAST(date_trunc('week', hit_date) AS DATE) ELSE hit_date END AS slot
          FROM (SELECT *, 'backtest' AS source, 0 AS src FROM hits1 UNION ALL SELECT *, 'live', 1 FROM hits2) u
          JOIN rules r ON r.scanner = u.scanner))
WHERE n = 1""", HITS2))
def signals_union(spark, sf):
    return sig.union_hits(sources_of(spark, sf), RULES)


@query("tier_known", "F8 F9 J14", with_views("hits1 hits2", """
SELECT h.scanner, h.symbol, h.hit_date, coalesce(k.tier, CASE WHEN s_acctbal * 20 >= 100000 THEN 'Largecap'
       WHEN s_acctbal * 20 >= 30000 THEN 'Midcap' ELSE 'Smallcap' END) AS tier,
       CASE coalesce(k.tier, CASE WHEN s_acctbal * 20 >= 100000 THEN 'Largecap'
       WHEN s_acctbal * 20 >= 30000 THEN 'Midcap' ELSE 'Smallcap' END) WHEN 'Midcap' THEN 0 WHEN 'Largecap' THEN 1 ELSE 2 END AS priority
FROM hits2 h JOIN supplier ON s_suppkey = h.symbol
LEFT JOIN (SELECT symbol, last(tier ORDER BY hit_date, tier, sector) AS tier FROM hits1
           WHERE tier <> '' AND hit_date < DATE '1995-06-01' GROUP BY symbol) k ON k.symbol = h.symbol""", HITS2))
def tier_known(spark, sf):
    exported, live = sources_of(spark, sf)
    early = exported.where(F.col("hit_date") < F.lit("1995-06-01").cast("date"))
    size = standin.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") * 20).alias("mcap")
    )
    sized = live.drop("tier").join(size, "symbol")
    out = sig.with_tier(sized, early, "mcap")
    return out.select("scanner", "symbol", "hit_date", "tier", "priority")


@query("confirmed_by", "J10 U5", with_views("signals", """
SELECT a.scanner, a.symbol, a.hit_date, coalesce(string_agg(DISTINCT b.scanner, ',' ORDER BY b.scanner), '') AS confirmed_by
FROM signals a LEFT JOIN signals b ON b.symbol = a.symbol AND b.scanner <> a.scanner
     AND b.hit_date BETWEEN a.hit_date - INTERVAL 10 DAY AND a.hit_date
GROUP BY a.scanner, a.symbol, a.hit_date"""))
def confirmed_by(spark, sf):
    out = sig.confirmations(standin.signals(spark, sf))
    return out.select("scanner", "symbol", "hit_date", F.array_join("confirmed_by", ",").alias("confirmed_by"))


@query("snap_session", "J3", with_views("hits2 bars", """
SELECT h.scanner, h.symbol, h.hit_date,
       CASE WHEN (SELECT max(date) FROM bars b WHERE b.symbol = h.symbol) > h.hit_date
            THEN coalesce(b.date, h.hit_date) ELSE h.hit_date END AS session_date
FROM hits2 h ASOF LEFT JOIN bars b ON b.symbol = h.symbol AND b.date <= h.hit_date""", HITS2))
def snap_session(spark, sf):
    live = sources_of(spark, sf)[1].select("scanner", "symbol", "hit_date")
    return asof.snap_to_session(live, standin.bar_table(spark, sf))


@query("signal_bar", "E1 J1 J2 M6", with_views("located", """
SELECT scanner, symbol, hit_date, start_pos, end_pos, signal_date, round(trigger, 4) AS trigger,
       round((trigger - bar_low) / bar_close * 100, 6) AS bar_range_pct,
       CASE WHEN trigger > bar_low THEN round((bar_close - bar_low) / (trigger - bar_low), 6) WHEN trigger IS NOT NULL THEN 1.0 END AS close_pos_in_bar,
       round((trigger / bar_close - 1) * 100, 6) AS trigger_gap_pct, round((trigger - bar_low) / trigger * 100, 6) AS bar_risk_pct
FROM located"""))
def signal_bar(spark, sf):
    from ..functions.numbers import candle_shape

    at = sig.locate(standin.signals(spark, sf), standin.bar_table(spark, sf), RULES)
    shape = candle_shape(F.col("trigger"), F.col("bar_low"), F.col("bar_close"))
    shape["close_pos_in_bar"] = F.when(F.col("trigger").isNotNull(), shape["close_pos_in_bar"])
    out = at.withColumns(shape)
    names = list(shape)
    return rounded(rounded(out, 6, *names), 4, "trigger").select(
        "scanner", "symbol", "hit_date", "start_pos", "end_pos", "signal_date", "trigger", *names
    )


@query("entry_filter", "F5 F6 F7", with_views("located measures", """
SELECT scanner, symbol, hit_date, passes,
       CASE WHEN dist < -near_high THEN printf('%.0f', -dist) || '% below its 52-week high (limit ' || printf('%.0f', near_high) || '%)'
            WHEN atr >= atr_max THEN 'too volatile: daily ATR ' || printf('%.1f', atr) || '% of price (limit ' || printf('%.0f', atr_max) || '%)' END AS why
FROM (SELECT *, coalesce(dist >= -near_high, true) AND coalesce(atr < atr_max, true) AS passes
      FROM (SELECT l.*, round(m.dist, 2) AS dist, CASE WHEN m.pos >= 14 THEN round(m.atr, 2) END AS atr
            FROM located l JOIN measures m ON m.symbol = l.symbol AND m.pos = l.end_pos))"""))
def entry_filter(spark, sf):
    measured = indicators.filter_measures(standin.bar_table(spark, sf))
    at = sig.locate(standin.signals(spark, sf), measured, RULES, ["filter_dist", "filter_atr"])
    known = at.where(F.col("end_pos").isNotNull())
    args = (F.col("scanner"), F.col("filter_dist"), F.col("filter_atr"))
    return known.select(
        "scanner", "symbol", "hit_date", RULES.passes(*args).alias("passes"), RULES.skip_reason(*args).alias("why")
    )


@query("first_touch", "E2 E3 J4", with_views("touches", """
SELECT scanner, symbol, hit_date, status, entry_pos, entry_date, round(entry, 4) AS entry, gap, sessions_left FROM touches"""))
def first_touch(spark, sf):
    at = sig.locate(standin.signals(spark, sf), standin.bar_table(spark, sf), RULES)
    out = outcomes.first_touch(at, RULES)
    return rounded(out, 4, "entry").select(
        "scanner", "symbol", "hit_date", "status", "entry_pos", "entry_date", "entry", "gap", "sessions_left"
    )


@query("barrier_exit", "E4 E5 J5 C1", with_views("results", """
SELECT scanner, symbol, hit_date, result AS status, round(stop, 6) AS stop, round(exit, 6) AS exit, exit_date, sell_signal,
       round(now, 6) AS now, round(ma, 6) AS ma, left_over AS sessions_left,
       CAST(printf('%.2f', (coalesce(exit, now) / entry - 1) * 100 - 0.25) AS DOUBLE) AS ret
FROM results"""))
def barrier_exit(spark, sf):
    bars = standin.bar_table(spark, sf)
    at = outcomes.first_touch(sig.locate(standin.signals(spark, sf), bars, RULES), RULES)
    out = outcomes.barrier_exit(at, bars, RULES)
    return rounded(out, 6, "stop", "exit", "now", "ma").select(
        "scanner", "symbol", "hit_date", "status", "stop", "exit", "exit_date", "sell_signal", "now", "ma",
        "sessions_left", "ret",
    )


@query("closed_trades", "E7 D4", with_views("trades", """
SELECT scanner, symbol, hit_date, tier, result AS status, entry_date, exit_date, ret, days FROM trades"""))
def closed_trades(spark, sf):
    return closed(spark, sf).select(
        "scanner", "symbol", "hit_date", "tier", "status", "entry_date", "exit_date", "ret", "days"
    )


@query("order_duplicates", "W14", with_views("touches", """
SELECT scanner, symbol, hit_date, status,
       coalesce(bool_or(status = 'waiting') OVER (PARTITION BY scanner, symbol ORDER BY hit_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS duplicate
FROM touches"""))
def order_duplicates(spark, sf):
    at = outcomes.first_touch(sig.locate(standin.signals(spark, sf), standin.bar_table(spark, sf), RULES), RULES)
    return sig.mark_duplicates(at).select("scanner", "symbol", "hit_date", "status", "duplicate")


@query("order_deadlines", "D5 F9", with_views("touches", """
SELECT scanner, symbol, hit_date, signal_date, priority,
       DATE '1970-01-05' + CAST(7 * (total // 5) + total % 5 AS INTEGER) AS valid_until
FROM (SELECT *, 5 * (d // 7) + least(d % 7, 4) + entry_window AS total,
             CASE tier WHEN 'Midcap' THEN 0 WHEN 'Largecap' THEN 1 WHEN 'Smallcap' THEN 2 ELSE 3 END AS priority
      FROM (SELECT *, date_diff('day', DATE '1970-01-05', signal_date) AS d FROM touches))"""))
def order_deadlines(spark, sf):
    at = sig.locate(standin.signals(spark, sf), standin.bar_table(spark, sf), RULES)
    end = dates.add_workdays(F.col("signal_date"), RULES.value(F.col("scanner"), "window"))
    return at.select(
        "scanner", "symbol", "hit_date", "signal_date", tier_priority(F.col("tier")).alias("priority"), end.alias("valid_until")
    )


HOLD_VIEWS = {
    "calendar": (["index_bars"], """
        SELECT d.date, a.close, b.close AS before
        FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM index_bars) d
        ASOF LEFT JOIN index_bars a ON a.date <= d.date ASOF LEFT JOIN index_bars b ON b.date < d.date"""),
    "horizons": ([], "SELECT * FROM (VALUES ('2w', 10), ('1m', 21), ('3m', 63), ('6m', 126), ('1y', 252), ('2y', 504)) AS h(horizon, n)"),
    "reached": (["touches", "bars", "horizons", "calendar"], """
        SELECT t.scanner, t.symbol, t.hit_date, h.horizon, b.close, i.close AS idx, i0.before AS idx0,
               (SELECT max(p.close) FROM bars p WHERE p.symbol = t.symbol AND p.pos BETWEEN t.entry_pos AND t.entry_pos + h.n) AS top,
               (SELECT min(p.close) FROM bars p WHERE p.symbol = t.symbol AND p.pos BETWEEN t.entry_pos AND t.entry_pos + h.n) AS low
        FROM touches t CROSS JOIN horizons h JOIN bars b ON b.symbol = t.symbol AND b.pos = t.entry_pos + h.n
             JOIN calendar i ON i.date = b.date JOIN calendar i0 ON i0.date = t.entry_date"""),
    "holds": (["touches", "reached"], """
        SELECT t.scanner, t.symbol, t.hit_date, t.tier, t.sector,
               CASE t.status WHEN 'touched' THEN 'bought' WHEN 'waiting' THEN 'pending' WHEN 'no bar' THEN 'no_price_data' ELSE 'not_triggered' END AS status,
               t.entry_date, r.horizon, round_even((r.close / t.entry - 1) * 100 * 100, 0) / 100 AS ret, round_even((r.top / t.entry - 1) * 100 * 100, 0) / 100 AS best,
               round_even((r.low / t.entry - 1) * 100 * 100, 0) / 100 AS worst, round_even((r.idx / r.idx0 - 1) * 100 * 100, 0) / 100 AS index_ret
        FROM touches t LEFT JOIN reached r ON r.scanner = t.scanner AND r.symbol = t.symbol AND r.hit_date = t.hit_date"""),
}


@query("hold_outcomes", "E6 J6 J7 J9 W22", with_views("holds", """
SELECT scanner, symbol, hit_date, status, entry_date, horizon, ret, best, worst, index_ret FROM holds""", HOLD_VIEWS))
def hold_outcomes(spark, sf):
    return holds(spark, sf).select(
        "scanner", "symbol", "hit_date", "status", "entry_date", "horizon", "ret", "best", "worst", "index_ret"
    )


@query("status_counts", "A1", with_views("touches", """
SELECT scanner, count(*) FILTER (WHERE status = 'touched') AS bought, count(*) FILTER (WHERE status = 'no breakout') AS not_triggered,
       count(*) FILTER (WHERE status = 'no bar') AS no_price_data, count(*) FILTER (WHERE status = 'waiting') AS pending
FROM touches GROUP BY scanner"""))
def status_counts(spark, sf):
    at = outcomes.first_touch(sig.locate(standin.signals(spark, sf), standin.bar_table(spark, sf), RULES), RULES)
    return summaries.status_counts(at)


@query("horizon_stats", "A2 X5", with_views("holds", """
SELECT scanner, horizon, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 7) AS up, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) AS DOUBLE) / count(ret) / 100) AS mean,
       round(median(ret), 7) AS median, (CAST(sum(CAST(round((best) * 100) AS BIGINT)) AS DOUBLE) / count(best) / 100) AS best, (CAST(sum(CAST(round((worst) * 100) AS BIGINT)) AS DOUBLE) / count(worst) / 100) AS worst,
       (CAST(sum(CAST(round((index_ret) * 100) AS BIGINT)) AS DOUBLE) / count(index_ret) / 100) AS index_mean, round(avg(CASE WHEN ret > index_ret THEN 1.0 ELSE 0.0 END), 7) AS beat,
       (CAST(sum(CAST(round((ret - index_ret) * 100) AS BIGINT)) AS DOUBLE) / count(ret - index_ret) / 100) AS excess
FROM holds WHERE horizon IS NOT NULL GROUP BY scanner, horizon""", HOLD_VIEWS))
def horizon_stats(spark, sf):
    out = summaries.horizon_stats(holds(spark, sf))
    return rounded(out, 7, "up", "median", "beat")


@query("group_cells", "A3", with_views("holds", """
SELECT scanner, horizon, dimension, grp, n, CASE WHEN n >= min_n THEN up END AS up,
       CASE WHEN n >= min_n THEN mean END AS mean, CASE WHEN n >= min_n THEN excess END AS excess
FROM (SELECT scanner, horizon, dimension, coalesce(nullif(grp, ''), 'Unknown') AS grp, count(*) AS n, max(min_n) AS min_n,
             round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 7) AS up, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) AS DOUBLE) / count(ret) / 100) AS mean, (CAST(sum(CAST(round((ret - index_ret) * 100) AS BIGINT)) AS DOUBLE) / count(ret - index_ret) / 100) AS excess
      FROM (SELECT *, 'tier' AS dimension, tier AS grp, 10 AS min_n FROM holds
            UNION ALL SELECT *, 'year', CAST(year(entry_date) AS VARCHAR), 10 FROM holds
            UNION ALL SELECT *, 'sector', sector, 20 FROM holds)
      WHERE horizon IS NOT NULL GROUP BY ALL)""", HOLD_VIEWS))
def group_cells(spark, sf):
    return rounded(summaries.group_cells(holds(spark, sf)), 7, "up")


SUMMARY_VIEWS = HOLD_VIEWS | {
    "per_symbol": (["holds", "touches"], """
        SELECT b.*, h.* EXCLUDE (scanner, symbol)
        FROM (SELECT scanner, symbol, count(*) AS signals, min(entry_date) AS first, max(entry_date) AS last,
                     last(tier ORDER BY hit_date) FILTER (WHERE tier IS NOT NULL) AS tier,
                     last(sector ORDER BY hit_date) FILTER (WHERE sector IS NOT NULL) AS sector
              FROM touches WHERE status = 'touched' GROUP BY scanner, symbol) b
        JOIN (SELECT scanner, symbol, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '1m') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '1m') / 100) AS avg_1m, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '6m') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '6m') / 100) AS avg_6m,
                     (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '1y') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '1y') / 100) AS avg_1y,
                     100 * avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE horizon = '1y') AS up_1y
              FROM holds WHERE status = 'bought' GROUP BY scanner, symbol) h
        ON h.scanner = b.scanner AND h.symbol = b.symbol"""),
}


@query("symbol_summary", "A4 X5", with_views("per_symbol", """
SELECT scanner, symbol, signals, first, last, tier, sector, avg_1m AS avg_1m, avg_6m AS avg_6m,
       avg_1y AS avg_1y, round(up_1y, 7) AS up_1y FROM per_symbol""", SUMMARY_VIEWS))
def symbol_summary(spark, sf):
    out = summaries.symbol_summary(holds(spark, sf))
    names = ["avg_1m", "avg_6m", "avg_1y", "up_1y"]
    return rounded(out, 7, "up_1y").select("scanner", "symbol", "signals", "first", "last", "tier", "sector", *names)


@query("best_worst_symbols", "L3", with_views("per_symbol", """
SELECT scanner, side, place, symbol, avg_1y AS avg_1y FROM (
    SELECT scanner, symbol, avg_1y, 'best' AS side, row_number() OVER (PARTITION BY scanner ORDER BY round(avg_1y, 6) DESC, symbol) AS place
    FROM per_symbol WHERE signals >= 3 AND avg_1y IS NOT NULL
    UNION ALL
    SELECT scanner, symbol, avg_1y, 'worst', row_number() OVER (PARTITION BY scanner ORDER BY round(avg_1y, 6), symbol)
    FROM per_symbol WHERE signals >= 3 AND avg_1y IS NOT NULL) WHERE place <= 10""", SUMMARY_VIEWS))
def best_worst_symbols(spark, sf):
    out = summaries.best_and_worst(summaries.symbol_summary(holds(spark, sf)), "avg_1y")
    return out.select("scanner", "side", "place", "symbol", "avg_1y")


@query("biggest_winners", "L3 L1", with_views("holds", """
SELECT scanner, symbol, hit_date, ret, index_ret FROM (
    SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY ret DESC, hit_date, symbol) AS n FROM holds WHERE horizon = '1y') WHERE n <= 10""", HOLD_VIEWS))
def biggest_winners(spark, sf):
    year = holds(spark, sf).where(F.col("horizon") == "1y")
    top = pick_per_key(year, ["scanner"], [F.desc("ret"), F.col("hit_date"), F.col("symbol")], 10)
    return top.select("scanner", "symbol", "hit_date", "ret", "index_ret")


@query("scanner_glance", "A2", with_views("holds touches", """
SELECT t.scanner, t.signals, t.bought, h.m1 AS avg_1m, h.m6 AS avg_6m, h.y1 AS avg_1y, h.y2 AS avg_2y, h.x1 AS excess_1y
FROM (SELECT scanner, count(*) AS signals, count(*) FILTER (WHERE status = 'touched') AS bought FROM touches GROUP BY scanner) t
JOIN (SELECT scanner, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '1m') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '1m') / 100) AS m1, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '6m') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '6m') / 100) AS m6, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '1y') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '1y') / 100) AS y1,
             (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '2y') AS DOUBLE) / count(ret) FILTER (WHERE horizon = '2y') / 100) AS y2, (CAST(sum(CAST(round((ret - index_ret) * 100) AS BIGINT)) FILTER (WHERE horizon = '1y') AS DOUBLE) / count(ret - index_ret) FILTER (WHERE horizon = '1y') / 100) AS x1 FROM holds GROUP BY scanner) h USING (scanner)""", HOLD_VIEWS))
def scanner_glance(spark, sf):
    return summaries.scanner_glance(holds(spark, sf))


@query("trade_breakdown", "A5", with_views("trades", """
SELECT grp, count(*) AS trades, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 7) AS win, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) AS DOUBLE) / count(ret) / 100) AS mean,
       (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE ret > 0) AS DOUBLE) / count(ret) FILTER (WHERE ret > 0) / 100) AS mean_win, (CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE ret <= 0) AS DOUBLE) / count(ret) FILTER (WHERE ret <= 0) / 100) AS mean_loss,
       round(avg(CASE WHEN result = 'average' THEN 1.0 ELSE 0.0 END), 7) AS average_share, round(avg(CASE WHEN result = 'stop' THEN 1.0 ELSE 0.0 END), 7) AS stop_share,
       round(avg(CASE WHEN result = 'time' THEN 1.0 ELSE 0.0 END), 7) AS time_share, round(avg(days), 7) AS days, CAST(round(sum(ret * 1000)) AS BIGINT) AS profit
FROM (SELECT *, scanner AS grp FROM trades UNION ALL SELECT *, tier FROM trades WHERE tier <> '' UNION ALL SELECT *, 'All' FROM trades) GROUP BY grp"""))
def trade_breakdown(spark, sf):
    out = summaries.trade_breakdown(closed(spark, sf))
    return rounded(out, 7, "win", "average_share", "stop_share", "time_share", "days")


@query("trade_rollup", "A6 A7", with_views("trades", """
SELECT coalesce(scanner, 'All') AS scanner, count(*) AS trades, CAST(round(100 * avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS win, round((CAST(sum(CAST(round((ret) * 100) AS BIGINT)) AS DOUBLE) / count(ret) / 100), 2) AS mean,
       round((CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE ret > 0) AS DOUBLE) / count(ret) FILTER (WHERE ret > 0) / 100), 1) AS mean_win, round((CAST(sum(CAST(round((ret) * 100) AS BIGINT)) FILTER (WHERE ret <= 0) AS DOUBLE) / count(ret) FILTER (WHERE ret <= 0) / 100), 1) AS mean_loss, CAST(round(avg(days)) AS BIGINT) AS days
FROM trades WHERE entry_date >= (SELECT max(m) FROM (SELECT min(entry_date) AS m FROM trades GROUP BY scanner)) GROUP BY ROLLUP (scanner)"""))
def trade_rollup(spark, sf):
    return summaries.trade_rollup(summaries.from_common_start(closed(spark, sf)))


@query("trade_paths", "W19", with_views("trades path", """
SELECT t.scanner, t.symbol, t.hit_date, count(*) AS points, min(p.date) AS first_day, max(p.date) AS last_day, round(sum(p.close), 3) AS close_sum,
       count(p.ema) AS lined
FROM trades t JOIN path x ON x.symbol = t.symbol AND x.date = t.exit_date
JOIN path p ON p.symbol = t.symbol AND p.pos BETWEEN greatest(t.end_pos - 10, 0) AND least(x.pos + 3, t.n_bars - 1) GROUP BY ALL"""))
def trade_paths(spark, sf):
    lined = indicators.exit_line(standin.bar_table(spark, sf))
    points = outcomes.trade_paths(closed(spark, sf), lined)
    return points.groupBy("scanner", "symbol", "hit_date").agg(
        F.count(F.lit(1)).alias("points"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.round(F.sum("close"), 3).alias("close_sum"), F.count("ema").alias("lined"),
    )

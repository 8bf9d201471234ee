"""Live states, dashboard views, sector views and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.keys import beside
from ..functions import dates
from ..operators import indicators, keys, membership
from ..plans import live, quality
from ..plans import views as view_plan
from ..operators.signals import KEY
from ..session import stored
from ..sources import standin
from .base import query, with_views
from .market import rounded

TODAY = "1999-01-30"
END = "2001-11-04"


def day(text):
    return F.lit(text).cast("date")


def states_of(spark, sf):
    hits = standin.hits(spark, sf)
    measured = indicators.filter_measures(standin.bar_table(spark, sf))
    return live.signal_states(hits, measured, hits, standin.RULES)


def fixed_states(spark, sf, *columns):
    """Key, status and the columns named of the states, written once, for views that read them along several branches."""
    return stored(states_of(spark, sf).select(*KEY, "status", *columns))


def entry_events(spark, sf):
    """Entries among the bars: 25 years back, on their local day, at a price near the bars'."""
    found = membership.entries(standin.members(spark, sf))
    return found.select(
        "scanner", "symbol", "run", "kind", F.date_sub(F.to_date(dates.local_time(F.col("run_at"))), standin.SHIFT_DAYS).alias("day"),
        (F.col("value") + 900).alias("trigger"),
    )


def scan_prices(spark, sf):
    latest = keys.latest_values(standin.members(spark, sf), ["scanner", "symbol"], ["run"], ["run", "value"])
    return latest.select("scanner", "symbol", "run", (F.col("value") + 900).alias("price"))


def current_members(spark, sf):
    newest = standin.table(spark, sf, "events").agg(F.floor(F.unix_timestamp(F.max("ts")) / 21600).alias("newest"))
    rows = scan_prices(spark, sf).transform(beside, newest)
    return rows.where(F.col("run") == F.col("newest")).drop("newest")


STATES = {
    "states0": (["touches", "results", "measures"], """
        SELECT t.scanner, t.symbol, t.hit_date, t.signal_date, t.entry_window, t.trigger,
               CASE WHEN t.end_pos IS NULL THEN 'no prices yet' WHEN NOT t.passed THEN 'skipped' ELSE coalesce(r.result, t.status) END AS status,
               CASE WHEN t.passed THEN t.entry_date END AS entry_date, CASE WHEN t.passed THEN t.entry END AS entry,
               CASE WHEN t.passed THEN r.exit END AS exit, CASE WHEN t.passed THEN r.exit_date END AS exit_date,
               CASE WHEN t.passed THEN r.sell_signal END AS sell_signal, CASE WHEN t.passed THEN r.last_date END AS last_date, CASE WHEN t.passed THEN r.last_close END AS last_close,
               CASE WHEN t.passed THEN CAST(printf('%.2f', (coalesce(r.exit, r.now) / r.entry - 1) * 100 - 0.25) AS DOUBLE) END AS ret, t.dist, t.atr, t.near_high, t.atr_max
        FROM (SELECT t.*, round(m.dist, 2) AS dist, CASE WHEN m.pos >= 14 THEN round(m.atr, 2) END AS atr,
                     t.end_pos IS NULL OR (coalesce(round(m.dist, 2) >= -t.near_high, true) AND coalesce(CASE WHEN m.pos >= 14 THEN round(m.atr, 2) END < t.atr_max, true)) AS passed
              FROM touches t LEFT JOIN measures m ON m.symbol = t.symbol AND m.pos = t.end_pos) t
        LEFT JOIN results r ON r.scanner = t.scanner AND r.symbol = t.symbol AND r.hit_date = t.hit_date"""),
    "tier_now": (["hits1"], "SELECT symbol, last(tier ORDER BY hit_date, tier, sector) AS tier FROM hits1 WHERE tier <> '' GROUP BY symbol"),
    "states": (["states0", "tier_now"], """
        SELECT s.* EXCLUDE (status, trigger, entry_date, entry, exit, exit_date, ret, sell_signal, last_date, last_close), CASE WHEN dup THEN 'duplicate' ELSE status END AS status,
               CASE WHEN NOT dup THEN trigger END AS trigger, CASE WHEN NOT dup THEN entry_date END AS entry_date, CASE WHEN NOT dup THEN entry END AS entry,
               CASE WHEN NOT dup THEN exit END AS exit, CASE WHEN NOT dup THEN exit_date END AS exit_date, CASE WHEN NOT dup THEN ret END AS ret,
               CASE WHEN NOT dup THEN sell_signal END AS sell_signal, CASE WHEN NOT dup THEN last_date END AS last_date, CASE WHEN NOT dup THEN last_close END AS last_close, k.tier
        FROM (SELECT *, coalesce(bool_or(status = 'waiting') OVER (PARTITION BY scanner, symbol ORDER BY hit_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dup FROM states0) s
        LEFT JOIN tier_now k ON k.symbol = s.symbol"""),
    "orders": (["states"], """
        SELECT scanner, symbol, hit_date FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hit_date DESC, scanner) AS n FROM states
            WHERE status = 'waiting' AND symbol NOT IN (SELECT symbol FROM states WHERE status = 'holding')) WHERE n = 1"""),
    "shifted": (["entries"], f"""
        SELECT scanner, symbol, run, kind, CAST(run_at + INTERVAL 330 MINUTE AS DATE) - {standin.SHIFT_DAYS} AS day, value + 900 AS trigger FROM entries"""),
    "scan_now": (["members"], "SELECT scanner, symbol, max(run) AS run, arg_max(value, run) + 900 AS price FROM members GROUP BY ALL"),
    "followed": (["shifted", "bars", "scan_now"], """
        SELECT e.*, s.price AS scan_price, s.run = (SELECT max(run) FROM members) AS on_scan,
               CASE WHEN b.last_date >= e.day THEN CAST(printf('%.2f', b.last_close) AS DOUBLE) ELSE s.price END AS now, CASE WHEN b.last_date >= e.day THEN b.last_date END AS now_date,
               x.best, x.worst, CASE WHEN b.last_date >= e.day THEN coalesce(x.days, 0) END AS days
        FROM shifted e JOIN scan_now s ON s.scanner = e.scanner AND s.symbol = e.symbol
        LEFT JOIN (SELECT symbol, max(date) AS last_date, arg_max(close, date) AS last_close FROM bars GROUP BY symbol) b ON b.symbol = e.symbol
        LEFT JOIN (SELECT e.scanner, e.symbol, e.run, max(high) AS best, min(low) AS worst, count(*) AS days
                   FROM shifted e JOIN bars b ON b.symbol = e.symbol AND b.date > e.day GROUP BY ALL) x
               ON x.scanner = e.scanner AND x.symbol = e.symbol AND x.run = e.run"""),
}


def pct(base, value):
    return f"CAST(printf('%.2f', ({value} - {base}) / {base} * 100) AS DOUBLE)"


@query("live_states", "E8 F5 W14 J10 F8 F9", with_views("states", """
SELECT scanner, symbol, hit_date, status, tier, CASE tier WHEN 'Midcap' THEN 0 WHEN 'Largecap' THEN 1 WHEN 'Smallcap' THEN 2 ELSE 3 END AS priority,
       round(trigger, 6) AS trigger, entry_date, exit_date, sell_signal, ret FROM states""", STATES))
def live_states(spark, sf):
    return rounded(states_of(spark, sf), 6, "trigger").select(
        "scanner", "symbol", "hit_date", "status", "tier", "priority", "trigger", "entry_date", "exit_date", "sell_signal", "ret"
    )


@query("book_summary", "A8 A26 M9", with_views("states", """
SELECT coalesce(scanner, 'All scanners') AS scanner, count(*) FILTER (WHERE status <> 'duplicate') AS signals, count(*) FILTER (WHERE status = 'waiting') AS watching,
       count(*) FILTER (WHERE status = 'holding') AS holding, count(*) FILTER (WHERE status IN ('stop', 'time', 'average')) AS closed,
       CAST(round(100.0 * count(*) FILTER (WHERE status IN ('stop', 'time', 'average') AND ret > 0) / count(*) FILTER (WHERE status IN ('stop', 'time', 'average'))) AS BIGINT) AS win,
       CAST(sum(CAST(round(ret * 1000) AS BIGINT)) FILTER (WHERE status IN ('stop', 'time', 'average')) AS BIGINT) AS pnl,
       CAST(coalesce(sum(CAST(round(ret * 1000) AS BIGINT)) FILTER (WHERE status = 'holding'), 0) AS BIGINT) AS open_pnl
FROM states GROUP BY ROLLUP (scanner)""", STATES))
def book_summary(spark, sf):
    return live.book_summary(states_of(spark, sf))


@query("event_feed", "E13 J25 K10", with_views("states", f"""
SELECT scanner || '|' || symbol || '|' || hit_date || '|' || tag AS key, scanner, symbol, hit_date, kind FROM (
    SELECT *, 'setup' AS tag, 'setup' AS kind FROM states WHERE status = 'waiting' AND symbol NOT IN (SELECT symbol FROM states WHERE status = 'holding')
    UNION ALL SELECT *, 'bought', 'bought' FROM states WHERE entry_date >= DATE '{END}' - 30
    UNION ALL SELECT *, 'sell', 'sell' FROM states WHERE sell_signal >= DATE '{END}' - 30
    UNION ALL SELECT *, 'exit', status FROM states WHERE status IN ('stop', 'time', 'average') AND exit_date >= DATE '{END}' - 30)
WHERE symbol % 10 <> 0 OR tag <> 'setup'""", STATES))
def event_feed(spark, sf):
    feed = live.event_feed(fixed_states(spark, sf, "entry_date", "sell_signal", "exit_date"), day(END), 30)
    # Setups of round symbols were sent before; their keys are the ledger.
    ledger = feed.where((F.col("symbol") % 10 == 0) & (F.col("kind") == "setup")).select("key")
    return feed.join(ledger, "key", "left_anti")


@query("outcome_text", "F25", with_views("states", """
SELECT scanner, symbol, hit_date, outcome, hit_date = max(hit_date) OVER (PARTITION BY scanner, symbol) AS latest FROM (
SELECT s.scanner, s.symbol, s.hit_date,
       CASE WHEN h.by = s.scanner THEN 'holding ' || printf('%+.1f', h.ret) || '%' WHEN h.by IS NOT NULL THEN 'holding (from ' || h.by || ')'
            WHEN status IN ('stop', 'time', 'average') THEN 'bought, sold ' || printf('%+.1f', s.ret) || '% (' || CASE status WHEN 'stop' THEN 'stop-loss' WHEN 'average' THEN 'below 30-day EMA' ELSE status END || ')'
            WHEN status = 'skipped' THEN 'skipped: ' || CASE WHEN dist < -near_high THEN printf('%.0f', -dist) || '% below its 52-week high (limit ' || printf('%.0f', near_high) || '%)' ELSE 'too volatile' END
            WHEN status = 'waiting' THEN 'buy-stop open' WHEN status = 'no breakout' THEN 'didn''t cross in time' WHEN status = 'no prices yet' THEN 'new: buy-stop after the close' END AS outcome
FROM states s LEFT JOIN (SELECT symbol, last(scanner ORDER BY hit_date, scanner) AS by, last(ret ORDER BY hit_date, scanner) AS ret FROM states WHERE status = 'holding' GROUP BY symbol) h ON h.symbol = s.symbol
WHERE status <> 'duplicate')""", STATES))
def outcome_text(spark, sf):
    return live.outcome_text(fixed_states(spark, sf, "ret", "why"))


@query("open_orders", "E14 L1", with_views("orders", "SELECT scanner, symbol, hit_date FROM orders", STATES))
def open_orders(spark, sf):
    return live.open_orders(fixed_states(spark, sf)).select("scanner", "symbol", "hit_date")


BUSDAY = """CAST(5 * (date_diff('day', DATE '1970-01-05', {b}) // 7) + least(date_diff('day', DATE '1970-01-05', {b}) % 7, 5)
       - 5 * (date_diff('day', DATE '1970-01-05', {a}) // 7) - least(date_diff('day', DATE '1970-01-05', {a}) % 7, 5) + 1 AS INTEGER)"""


@query("holdings", "E14 D4", with_views("states", f"""
SELECT scanner, symbol, hit_date, {BUSDAY.format(a='entry_date', b='last_date')} AS days,
       CAST(round(ret * 1000) AS BIGINT) AS pnl, CAST(round(100000 + ret * 1000) AS BIGINT) AS value FROM states WHERE status = 'holding'""", STATES))
def holdings(spark, sf):
    return live.holdings(states_of(spark, sf)).select("scanner", "symbol", "hit_date", "days", "pnl", "value")


@query("sold_trades", "E14 D4", with_views("states", f"""
SELECT scanner, symbol, hit_date, {BUSDAY.format(a='entry_date', b='exit_date')} AS days, CAST(round(ret * 1000) AS BIGINT) AS pnl
FROM states WHERE status IN ('stop', 'time', 'average')""", STATES))
def sold_trades(spark, sf):
    return live.sold(states_of(spark, sf)).select("scanner", "symbol", "hit_date", "days", "pnl")


@query("passed_over", "E14", with_views("states", f"""
SELECT scanner, symbol, hit_date, CASE WHEN dist < -near_high THEN printf('%.0f', -dist) || '% below its 52-week high (limit ' || printf('%.0f', near_high) || '%)'
       ELSE 'too volatile: daily ATR ' || printf('%.1f', atr) || '% of price (limit ' || printf('%.0f', atr_max) || '%)' END AS why
FROM (SELECT *, row_number() OVER (PARTITION BY scanner, symbol ORDER BY hit_date DESC) AS n FROM states
      WHERE status = 'skipped' AND hit_date >= DATE '{END}' - 200 AND symbol NOT IN (SELECT symbol FROM states WHERE status IN ('waiting', 'holding'))) WHERE n = 1""", STATES))
def passed_over(spark, sf):
    return live.passed_over(fixed_states(spark, sf, "why"), day(END), 200)


@query("to_do", "E18", with_views("states orders", f"""
SELECT 'sell' AS action, scanner, symbol, hit_date FROM states WHERE status = 'holding' AND sell_signal IS NOT NULL
UNION ALL SELECT 'order', scanner, symbol, hit_date FROM orders
UNION ALL SELECT 'bought', scanner, symbol, hit_date FROM states WHERE status = 'holding' AND sell_signal IS NULL AND entry_date >= DATE '{END}' - 30""", STATES))
def to_do(spark, sf):
    return live.to_do(fixed_states(spark, sf, "sell_signal", "entry_date"), day(END), 30)


@query("breakouts_view", "E15 J16 J17 F1 F2", with_views("followed", f"""
SELECT scanner, symbol, run, kind, day, trigger, now, now_date, {pct('trigger', 'now')} AS chg, {pct('trigger', 'best')} AS best_chg, {pct('trigger', 'worst')} AS worst_chg,
       days, on_scan, CASE WHEN {pct('trigger', 'now')} > 0 THEN 'BUY' ELSE 'HOLD' END AS status FROM followed""", STATES))
def breakouts_view(spark, sf):
    return view_plan.breakouts(entry_events(spark, sf), standin.bar_table(spark, sf), scan_prices(spark, sf), current_members(spark, sf))


@query("breakout_stats", "A9", with_views("followed", f"""
SELECT scanner, count(*) AS count, count(*) FILTER (WHERE {pct('trigger', 'now')} > 0) AS above,
       CAST(sum(CAST(round({pct('trigger', 'now')} * 100) AS BIGINT)) AS DOUBLE) / count({pct('trigger', 'now')}) / 100 AS avg_chg,
       CAST(sum(CAST(round({pct('trigger', 'best')} * 100) AS BIGINT)) AS DOUBLE) / count({pct('trigger', 'best')}) / 100 AS avg_best
FROM followed GROUP BY scanner""", STATES))
def breakout_stats(spark, sf):
    return view_plan.breakout_stats(breakouts_view(spark, sf))


@query("own_triggers", "J28 W12", with_views("followed hits1 bars", f"""
SELECT f.scanner, f.symbol, f.run, coalesce(CAST(printf('%.2f', x.high) AS DOUBLE), CAST(printf('%.2f', n.high) AS DOUBLE), f.trigger) AS trigger FROM followed f
LEFT JOIN (SELECT h.kind, h.symbol, h.hit_date, b.high FROM own h JOIN bars b ON b.symbol = h.symbol AND b.date = h.hit_date) x ON x.kind = f.scanner AND x.symbol = f.symbol AND x.hit_date = f.day
LEFT JOIN (SELECT h.kind, h.symbol, arg_max(b.high, h.hit_date) AS high FROM own h JOIN bars b ON b.symbol = h.symbol AND b.date = h.hit_date GROUP BY ALL) n ON n.kind = f.scanner AND n.symbol = f.symbol""".replace("own h", "(SELECT *, CASE scanner WHEN '2-HIGH' THEN 'click' ELSE 'view' END AS kind FROM hits1 WHERE scanner IN ('2-HIGH', '3-MEDIUM')) h"), STATES))
def own_triggers(spark, sf):
    rows = breakouts_view(spark, sf)
    hits = standin.hits(spark, sf).where(F.col("scanner").isin("2-HIGH", "3-MEDIUM")).withColumn(
        "scanner", F.when(F.col("scanner") == "2-HIGH", "click").otherwise("view")
    )
    highs = standin.bar_table(spark, sf).select("symbol", F.col("date").alias("hit_date"), F.col("high").alias("trigger"))
    states = hits.join(highs, ["symbol", "hit_date"])
    return view_plan.own_triggers(rows, states).select("scanner", "symbol", "run", "trigger")


@query("scanner_view", "E16 L2 J15", with_views("scan_now members entries", f"""
SELECT s.scanner, s.symbol, s.price AS now, t.trigger, t.day AS trigger_date, {pct('t.trigger', 's.price')} AS chg, CASE WHEN {pct('t.trigger', 's.price')} > 0 THEN 'BUY' ELSE 'HOLD' END AS status
FROM scan_now s JOIN (SELECT k.scanner, k.symbol, coalesce(b.value, f.value) + 900 AS trigger, CAST(coalesce(b.run_at, f.run_at) AS DATE) AS day
    FROM (SELECT DISTINCT scanner, symbol FROM members) k
    LEFT JOIN (SELECT scanner, symbol, arg_max(value, run) AS value, max(run_at) AS run_at FROM entries GROUP BY ALL) b USING (scanner, symbol)
    LEFT JOIN (SELECT scanner, symbol, arg_min(value, run) AS value, min(run_at) AS run_at FROM members GROUP BY ALL) f USING (scanner, symbol)) t
  ON t.scanner = s.scanner AND t.symbol = s.symbol
WHERE s.run = (SELECT max(run) FROM members)""", STATES))
def scanner_view(spark, sf):
    from .snapshots import trigger_lookup

    triggers = trigger_lookup(spark, sf).withColumn("trigger", F.col("trigger") + 900)
    return view_plan.scanner_view(current_members(spark, sf), triggers)


@query("digest_view", "E17", with_views("followed", f"""
SELECT scanner, symbol, trigger, price AS now, {pct('trigger', 'price')} AS chg, CASE WHEN {pct('trigger', 'price')} > 0 THEN 'BUY' ELSE 'HOLD' END AS group, NOT on_scan AS off_scan
FROM (SELECT *, CASE WHEN on_scan THEN scan_price ELSE coalesce(now, scan_price) END AS price, row_number() OVER (PARTITION BY scanner, symbol ORDER BY run DESC) AS n FROM followed) WHERE n = 1""", STATES))
def digest_view(spark, sf):
    return view_plan.digest(entry_events(spark, sf), standin.bar_table(spark, sf), scan_prices(spark, sf), current_members(spark, sf))


@query("sector_counts", "A10", with_views("hits1", f"""
SELECT scanner, sector, n FROM (SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY n DESC, sector) AS k FROM
    (SELECT scanner, sector, count(*) AS n FROM hits1 WHERE hit_date >= DATE '{TODAY}' - 90 GROUP BY ALL)) WHERE k <= 5"""))
def sector_counts(spark, sf):
    return view_plan.sector_counts(standin.hits(spark, sf), F.date_sub(day(TODAY), 90))


@query("sector_windows", "A11", with_views("hits1", f"""
SELECT scanner, sector, short, long FROM (
    SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY long DESC, short DESC, sector) AS k FROM (
        SELECT scanner, sector, CASE WHEN ks <= 5 THEN short ELSE 0 END AS short, CASE WHEN kl <= 5 THEN long ELSE 0 END AS long FROM (
            SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY short DESC, sector) AS ks, row_number() OVER (PARTITION BY scanner ORDER BY long DESC, sector) AS kl FROM (
                SELECT scanner, sector, count(*) FILTER (WHERE hit_date >= DATE '{TODAY}' - 20) AS short, count(*) AS long FROM hits1 WHERE hit_date >= DATE '{TODAY}' - 90 GROUP BY ALL)))
    WHERE short > 0 OR long > 0) WHERE k <= 5"""))
def sector_windows(spark, sf):
    return view_plan.sector_windows(standin.hits(spark, sf), day(TODAY), (20, 90))


def picks_of(spark, sf):
    hits = standin.hits(spark, sf)
    exported = hits.select(F.col("hit_date").alias("day"), "scanner", "symbol", "sector", F.lit(None).cast("double").alias("ref"))
    sector = keys.latest_values(hits, ["symbol"], ["hit_date"], ["sector"])
    live_picks = entry_events(spark, sf).join(sector, "symbol", "left").select("day", "scanner", "symbol", "sector", F.col("trigger").alias("ref"))
    before = F.col("day") <= day(TODAY)
    return exported.where(before).unionByName(live_picks.where(before))


MOMENTUM = STATES | {
    "picks": (["hits1", "shifted"], f"""
        SELECT hit_date AS day, scanner, symbol, coalesce(nullif(sector, ''), 'Unclassified') AS sector, NULL::DOUBLE AS ref FROM hits1 WHERE hit_date BETWEEN DATE '{TODAY}' - 55 AND DATE '{TODAY}'
        UNION ALL SELECT day, e.scanner, e.symbol, coalesce(nullif(k.sector, ''), 'Unclassified'), e.trigger FROM shifted e
        LEFT JOIN (SELECT symbol, last(sector ORDER BY hit_date, sector) AS sector FROM hits1 GROUP BY symbol) k ON k.symbol = e.symbol WHERE day BETWEEN DATE '{TODAY}' - 55 AND DATE '{TODAY}'"""),
    "moves": (["picks", "bars"], f"""
        SELECT p.sector, p.symbol, {pct('coalesce(p.ref, d.close)', 'z.close')} AS move
        FROM (SELECT sector, symbol, first(day ORDER BY day, scanner, ref NULLS FIRST) AS day, first(ref ORDER BY day, scanner, ref NULLS FIRST) AS ref FROM picks WHERE day >= DATE '{TODAY}' - 27 GROUP BY ALL) p
        LEFT JOIN bars d ON d.symbol = p.symbol AND d.date = p.day
        JOIN bars z ON z.symbol = p.symbol AND z.pos = z.n_bars - 1 AND z.date >= p.day"""),
    "momentum": (["picks", "moves"], f"""
        SELECT g.*, m.avg_move, coalesce(m.n, 0) AS moves_n, r.recent FROM (
            SELECT sector, count(DISTINCT symbol) FILTER (WHERE day >= DATE '{TODAY}' - 13) AS cur,
                   count(DISTINCT symbol) FILTER (WHERE day >= DATE '{TODAY}' - 27 AND day < DATE '{TODAY}' - 13) AS prev_all,
                   coalesce(string_agg(DISTINCT scanner, ',' ORDER BY scanner) FILTER (WHERE day >= DATE '{TODAY}' - 13), '') AS scanners
            FROM picks GROUP BY sector) g
        LEFT JOIN (SELECT sector, CAST(sum(CAST(round(move * 100) AS BIGINT)) AS DOUBLE) / count(move) / 100 AS avg_move, count(move) AS n FROM moves GROUP BY sector) m ON m.sector = g.sector
        LEFT JOIN (SELECT sector, string_agg(CAST(symbol AS VARCHAR), ',' ORDER BY k) AS recent FROM (
            SELECT *, row_number() OVER (PARTITION BY sector ORDER BY newest DESC, symbol DESC) AS k FROM (
                SELECT sector, symbol, max(ROW(day, scanner)) AS newest FROM picks WHERE day >= DATE '{TODAY}' - 13 GROUP BY ALL)) WHERE k <= 6 GROUP BY sector) r ON r.sector = g.sector
        WHERE cur > 0 OR prev_all > 0"""),
    "weekly_counts": (["picks"], f"""
        SELECT sector, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY w) AS weekly FROM (
            SELECT s.sector, s.w, c.n FROM (SELECT sector, w FROM (SELECT DISTINCT sector FROM picks), (SELECT unnest(generate_series(0, 7)) AS w)) s
            LEFT JOIN (SELECT sector, least(date_diff('day', DATE '{TODAY}' - 55, day) // 7, 7) AS w, count(DISTINCT symbol) AS n FROM picks GROUP BY ALL) c ON c.sector = s.sector AND c.w = s.w) GROUP BY sector"""),
}


@query("sector_momentum", "A12 A13 A15 A16", with_views("momentum weekly_counts", """
SELECT m.sector, cur, prev_all AS prev, scanners, avg_move, moves_n, weekly, coalesce(recent, '') AS recent FROM momentum m JOIN weekly_counts w ON w.sector = m.sector""", MOMENTUM))
def sector_momentum(spark, sf):
    out = view_plan.sector_momentum(picks_of(spark, sf), standin.bar_table(spark, sf), day(TODAY))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("scanners", "weekly", "recent")})


@query("top_movers", "L5", with_views("momentum", """
SELECT sector, diff, side FROM (
    SELECT sector, cur - prev_all AS diff, 'up' AS side, row_number() OVER (ORDER BY cur - prev_all DESC, sector) AS k FROM momentum WHERE cur > prev_all AND lower(sector) <> 'unclassified'
    UNION ALL SELECT sector, cur - prev_all, 'down', row_number() OVER (ORDER BY cur - prev_all, sector) FROM momentum WHERE cur < prev_all AND lower(sector) <> 'unclassified') WHERE k <= 3""", MOMENTUM))
def top_movers(spark, sf):
    return view_plan.top_movers(view_plan.sector_momentum(picks_of(spark, sf), standin.bar_table(spark, sf), day(TODAY)))


@query("event_dates_by_source", "J19 S9 D1", """
WITH named AS (SELECT s_suppkey AS symbol, CAST(max(o_orderdate) AS DATE) AS d FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-15' AND o_orderstatus = 'F' GROUP BY ALL),
told AS (SELECT l_suppkey AS symbol, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderpriority < '3' THEN 'results' ELSE 'board meeting' END AS what FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'),
other AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT symbol, arg_min(d, ROW(prio, d, what)) AS day, arg_min(what, ROW(prio, d, what)) AS what FROM (
    SELECT symbol, d, 'results' AS what, 0 AS prio FROM named UNION ALL SELECT symbol, d, what, 1 FROM told UNION ALL SELECT symbol, d, 'results', 2 FROM other)
WHERE d BETWEEN DATE '1998-01-05' AND DATE '1998-01-12' GROUP BY symbol""")
def event_dates_by_source(spark, sf):
    orders, items = standin.table(spark, sf, "orders"), standin.table(spark, sf, "lineitem")
    both = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_suppkey").alias("symbol"), "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    month = (F.col("o_orderdate") >= "1998-01-01") & (F.col("o_orderdate") < "1998-01-15") & (F.col("o_orderstatus") == "F")
    # Calendar dates arrive as text such as `5 Jan 1998`.
    listed = both.where(month).groupBy("symbol").agg(F.date_format(F.max("o_orderdate"), "d MMM yyyy").alias("text")).select(
        "symbol", dates.long_date(F.col("text")).alias("day"), F.lit("results").alias("what")
    ).where(F.col("day").isNotNull())
    told = both.where(F.col("o_orderstatus") == "O").select(
        "symbol", F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderpriority") < "3", "results").otherwise("board meeting").alias("what"),
    )
    other = items.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.lit("results").alias("what"))
    wanted = standin.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return view_plan.first_event_dates(wanted, [listed, told, other], day("1998-01-05"), day("1998-01-12"))


@query("event_dates_by_code", "J19 S9", """
WITH cal AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'S' || o_custkey END AS short_name,
                    CASE o_orderkey % 3 WHEN 1 THEN 'S' || o_custkey WHEN 2 THEN 'B' || o_custkey END AS code, CAST(o_orderdate AS DATE) AS d FROM orders),
syms AS (SELECT 'S' || c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'B' || c_custkey END AS mapped FROM customer)
SELECT symbol, arg_min(d, ROW(prio, d)) AS day, arg_min(what, ROW(prio, d)) AS what FROM (
    SELECT symbol, d, 'name' AS what, 0 AS prio FROM syms JOIN cal ON short_name = symbol
    UNION ALL SELECT symbol, d, 'code', 1 FROM syms JOIN cal ON code = symbol
    UNION ALL SELECT symbol, d, 'mapped code', 2 FROM syms JOIN cal ON code = mapped)
WHERE d BETWEEN DATE '1998-01-05' AND DATE '1998-02-20' GROUP BY symbol""")
def event_dates_by_code(spark, sf):
    """A calendar that names companies by short name, by own code or by another exchange's code."""
    k, own = F.col("o_orderkey") % 3, F.concat(F.lit("S"), "o_custkey")
    calendar = standin.table(spark, sf, "orders").select(
        F.when(k == 0, own).alias("short_name"), F.when(k == 1, own).when(k == 2, F.concat(F.lit("B"), "o_custkey")).alias("code"), F.to_date("o_orderdate").alias("day")
    )
    customers = standin.table(spark, sf, "customer")
    symbols = customers.select(F.concat(F.lit("S"), "c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("B"), "c_custkey")).alias("mapped"))
    return view_plan.first_event_dates(symbols, view_plan.calendar_sources(symbols, calendar), day("1998-01-05"), day("1998-02-20"))


@query("quality_checks", "A27 J22 D7", with_views("states members", f"""
SELECT * FROM (
WITH c AS (
    SELECT 'scan' AS name, date_diff('second', max(run_at), TIMESTAMP '2024-02-01 00:00:00') / 3600.0 < 80 AS ok, printf('%.0f', date_diff('second', max(run_at), TIMESTAMP '2024-02-01 00:00:00') / 3600.0) || ' h old' AS detail FROM members
    UNION ALL
    SELECT 'prices', count(*) FILTER (WHERE d <> m) = 0, count(*) FILTER (WHERE d <> m) || ' of ' || count(*) || ' behind' FROM (SELECT *, max(d) OVER () AS m FROM (SELECT symbol, max(last_date) AS d FROM states WHERE status = 'holding' GROUP BY symbol))
    UNION ALL
    SELECT 'trades', count(*) = 0, count(*) || ' mismatches' FROM (
        SELECT 1 FROM states s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = s.entry_date WHERE s.entry_date IS NOT NULL AND NOT coalesce(s.entry BETWEEN b.low - 0.01 AND b.high + 0.01, false)
        UNION ALL SELECT 1 FROM states s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = s.exit_date WHERE s.exit_date IS NOT NULL AND NOT coalesce(s.exit BETWEEN b.low - 0.01 AND b.high + 0.01, false)
        UNION ALL SELECT 1 FROM states s WHERE s.status = 'holding' AND abs((s.last_close / s.entry - 1) * 100 - 0.25 - s.ret) > 0.05)
    UNION ALL
    SELECT 'fundamentals', count(f) >= 0.8 * count(*) AND DATE '2024-02-01' - min(f) <= 45, count(f) || '/' || count(*) || ', oldest ' || (DATE '2024-02-01' - min(f)) || ' days'
    FROM (SELECT s.symbol, c.f FROM (SELECT DISTINCT symbol FROM states) s LEFT JOIN (SELECT user_id AS symbol, CAST(max(ts) AS DATE) AS f FROM events GROUP BY user_id) c ON c.symbol = s.symbol))
SELECT * FROM c UNION ALL SELECT 'overall', bool_and(ok), count(*) FILTER (WHERE NOT ok) || ' failed' FROM c)""", STATES))
def quality_checks(spark, sf):
    cache = standin.table(spark, sf, "events").groupBy(F.col("user_id").alias("symbol")).agg(F.to_date(F.max("ts")).alias("fetched_at"))
    states = fixed_states(spark, sf, "entry_date", "entry", "exit_date", "exit", "last_date", "last_close", "ret")
    return quality.checks(
        states, standin.bar_table(spark, sf), standin.members(spark, sf), cache,
        F.lit("2024-02-01 00:00:00").cast("timestamp"),
    )

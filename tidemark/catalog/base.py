"""Query registry and the SQL views the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import BY_SYMBOL, configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the operator ids it covers and its SQL check."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark, BY_SYMBOL), sf_dir)

        QUERIES[name] = run
        COVERS[name] = covers.split()
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


VIEWS: dict[str, tuple[list[str], str]] = {
    "ticks": ([], """
        SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, p_retailprice * (1 - l_discount) AS px,
               l_quantity AS qty, l_orderkey, l_linenumber, l_partkey
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "bars": (["ticks"], """
        SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS pos,
               CAST(count(*) OVER (PARTITION BY symbol) AS INTEGER) AS n_bars
        FROM (SELECT symbol, date,
                     first(px ORDER BY l_orderkey, l_linenumber, l_partkey, px) AS open,
                     max(px) AS high, min(px) AS low,
                     last(px ORDER BY l_orderkey, l_linenumber, l_partkey, px) AS close,
                     sum(qty) AS volume
              FROM ticks GROUP BY symbol, date)"""),
    "index_bars": (["bars"], """
        SELECT date, CAST(sum(CAST(round(close * 1000) AS BIGINT)) AS DOUBLE) / count(*) / 1000 AS close
        FROM bars GROUP BY date"""),
    "weeks": (["bars"], """
        SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, min(pos) AS start_pos, max(pos) AS end_pos,
               max(date) AS end_date, max(high) AS high, min(low) AS low, arg_max(close, pos) AS close,
               max(n_bars) AS n_bars
        FROM bars GROUP BY symbol, CAST(date_trunc('week', date) AS DATE)"""),
    "hits1": ([], """
        SELECT o_orderpriority AS scanner, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS hit_date,
               first(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Largecap' WHEN 'BUILDING' THEN 'Midcap'
                     WHEN 'FURNITURE' THEN 'Smallcap' ELSE '' END ORDER BY l_orderkey, l_partkey) AS tier,
               first(p_type ORDER BY l_orderkey, l_partkey) AS sector
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN part ON l_partkey = p_partkey
        GROUP BY ALL"""),
    "rules": ([], """
        SELECT * FROM (VALUES
            ('1-URGENT', true, 5, 15.0, NULL, 6.0, 250), ('2-HIGH', false, 3, 15.0, 10.0, NULL, 250),
            ('3-MEDIUM', false, 3, 6.0, NULL, NULL, 250), ('4-NOT SPECIFIED', false, 3, 15.0, NULL, NULL, 250),
            ('5-LOW', false, 3, 15.0, NULL, NULL, 5))
        AS r(scanner, weekly, entry_window, stop_pct, near_high, atr_max, max_hold)"""),
    "signals": (["hits1"], "SELECT * FROM hits1"),
    "located": (["signals", "rules", "bars", "weeks"], """
        SELECT s.*, r.weekly, r.entry_window, r.stop_pct, r.near_high, r.atr_max, r.max_hold,
               b.pos AS start_pos, b.pos AS end_pos, b.date AS signal_date, b.high AS trigger, b.low AS bar_low,
               b.close AS bar_close, b.n_bars
        FROM signals s JOIN rules r ON s.scanner = r.scanner AND NOT r.weekly
             LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = s.hit_date
        UNION ALL
        SELECT s.*, r.weekly, r.entry_window, r.stop_pct, r.near_high, r.atr_max, r.max_hold,
               w.start_pos, w.end_pos, w.end_date, w.high, w.low, w.close, w.n_bars
        FROM signals s JOIN rules r ON s.scanner = r.scanner AND r.weekly
             LEFT JOIN (SELECT * FROM weeks WHERE end_pos < n_bars - 1 OR isodow(end_date) >= 5) w
               ON w.symbol = s.symbol AND w.week = CAST(date_trunc('week', s.hit_date) AS DATE)"""),
    "touches": (["located", "bars"], """
        SELECT l.*, t.pos AS entry_pos, t.date AS entry_date, CASE WHEN t.pos IS NOT NULL THEN greatest(t.open, l.trigger) END AS entry,
               t.open > l.trigger AS gap,
               CASE WHEN l.end_pos IS NULL THEN 'no bar' WHEN t.pos IS NOT NULL THEN 'touched'
                    WHEN l.n_bars - 1 - l.end_pos < l.entry_window THEN 'waiting' ELSE 'no breakout' END AS status,
               CASE WHEN l.end_pos IS NOT NULL AND t.pos IS NULL
                    THEN greatest(l.entry_window - (l.n_bars - 1 - l.end_pos), 0) END AS sessions_left
        FROM located l LEFT JOIN (
            SELECT l.scanner, l.symbol, l.hit_date, arg_min(b, b.pos) AS t
            FROM located l JOIN bars b ON b.symbol = l.symbol AND b.pos > l.end_pos
                 AND b.pos <= l.end_pos + l.entry_window AND b.high > l.trigger
            GROUP BY ALL) x ON x.scanner = l.scanner AND x.symbol = l.symbol AND x.hit_date = l.hit_date
            LEFT JOIN bars t ON t.symbol = x.symbol AND t.pos = x.t.pos"""),
    "lined": (["bars"], """
        SELECT symbol, pos, e, CASE WHEN pos >= 29 THEN e END AS ema FROM ema_steps"""),
    "ema_steps": (["bars"], """
        SELECT symbol, pos, close AS e FROM bars WHERE pos = 0
        UNION ALL
        SELECT b.symbol, b.pos, s.e * (1 - 2.0::DOUBLE / 31) + b.close * (2.0::DOUBLE / 31)
        FROM ema_steps s JOIN bars b ON b.symbol = s.symbol AND b.pos = s.pos + 1"""),
    "path": (["bars", "lined"], """
        SELECT b.*, l.ema, lead(b.open) OVER w AS next_open, lead(b.date) OVER w AS next_date
        FROM bars b JOIN lined l ON l.symbol = b.symbol AND l.pos = b.pos
        WINDOW w AS (PARTITION BY b.symbol ORDER BY b.pos)"""),
    "exits": (["touches", "path"], """
        SELECT t.*, t.entry * (1 - t.stop_pct / 100) AS stop, x.s_pos, x.a_pos, z.date AS last_date,
               z.close AS last_close, z.ema AS last_ema, s.open AS s_open, s.date AS s_date,
               a.next_open AS a_open, a.next_date AS a_date, a.date AS a_day, a.close AS a_close, a.ema AS a_ema,
               c.close AS c_close, c.date AS c_date
        FROM touches t
        JOIN (SELECT t.scanner, t.symbol, t.hit_date,
                     min(CASE WHEN p.low <= t.entry * (1 - t.stop_pct / 100)
                                OR (p.pos > t.entry_pos AND p.open <= t.entry * (1 - t.stop_pct / 100)) THEN p.pos END) AS s_pos,
                     min(CASE WHEN p.pos > t.entry_pos AND p.close < p.ema THEN p.pos END) AS a_pos
              FROM touches t JOIN path p ON p.symbol = t.symbol
                   AND p.pos BETWEEN t.entry_pos AND t.entry_pos + t.max_hold
              WHERE t.entry_pos IS NOT NULL GROUP BY ALL) x
          ON x.scanner = t.scanner AND x.symbol = t.symbol AND x.hit_date = t.hit_date
        JOIN path z ON z.symbol = t.symbol AND z.pos = t.n_bars - 1
        LEFT JOIN path s ON s.symbol = t.symbol AND s.pos = x.s_pos
        LEFT JOIN path a ON a.symbol = t.symbol AND a.pos = x.a_pos
        LEFT JOIN path c ON c.symbol = t.symbol AND c.pos = t.entry_pos + t.max_hold"""),
    "results": (["exits"], """
        SELECT *, CASE WHEN kind = 'sell flag' THEN 'holding' ELSE kind END AS result,
               CASE kind WHEN 'stop' THEN CASE WHEN s_pos > entry_pos AND s_open <= stop THEN s_open ELSE stop END
                         WHEN 'average' THEN a_open WHEN 'time' THEN c_close END AS exit,
               CASE kind WHEN 'stop' THEN s_date WHEN 'average' THEN a_date WHEN 'time' THEN c_date END AS exit_date,
               CASE kind WHEN 'sell flag' THEN a_close WHEN 'holding' THEN last_close END AS now,
               CASE kind WHEN 'sell flag' THEN a_day END AS sell_signal,
               CASE WHEN kind IN ('sell flag', 'average') THEN a_ema WHEN kind = 'holding' THEN last_ema END AS ma,
               CASE kind WHEN 'sell flag' THEN 1 WHEN 'holding' THEN entry_pos + max_hold - (n_bars - 1) END AS left_over
        FROM (SELECT *, CASE WHEN s_pos IS NOT NULL AND (a_pos IS NULL OR s_pos <= a_pos) THEN 'stop'
                             WHEN a_pos IS NOT NULL AND a_date IS NOT NULL THEN 'average'
                             WHEN a_pos IS NOT NULL THEN 'sell flag'
                             WHEN entry_pos + max_hold <= n_bars - 1 THEN 'time' ELSE 'holding' END AS kind FROM exits)"""),
    "measures": (["bars"], """
        SELECT symbol, pos,
               CASE WHEN pos >= 119 THEN (close / max(high) OVER (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING) - 1) * 100 END AS dist,
               avg(tr) OVER (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING) / close * 100 AS atr
        FROM (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
              FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""),
    "trades": (["results", "measures"], """
        SELECT r.*, CAST(printf('%.2f', (r.exit / r.entry - 1) * 100 - 0.25) AS DOUBLE) AS ret,
               CAST(5 * (date_diff('day', DATE '1970-01-05', r.exit_date) // 7)
                    + least(date_diff('day', DATE '1970-01-05', r.exit_date) % 7, 5)
                    - 5 * (date_diff('day', DATE '1970-01-05', r.entry_date) // 7)
                    - least(date_diff('day', DATE '1970-01-05', r.entry_date) % 7, 5) + 1 AS INTEGER) AS days,
               m.dist AS dist_52w_high, m.atr AS atr_pct
        FROM results r JOIN measures m ON m.symbol = r.symbol AND m.pos = r.end_pos
        WHERE r.result <> 'holding'
          AND coalesce(round(m.dist, 2) >= -r.near_high, true)
          AND coalesce(CASE WHEN m.pos >= 14 THEN round(m.atr, 2) END < r.atr_max, true)"""),
    "members": ([], """
        SELECT event_type AS scanner, user_id AS symbol, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS run,
               make_timestamp(CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600000000) AS run_at, max(ts) AS seen_at,
               last(value ORDER BY ts, event_id) AS value, last(props ORDER BY ts, event_id) AS props
        FROM events GROUP BY ALL"""),
    "runs": (["members"], """
        SELECT *, lag(run) OVER (PARTITION BY scanner ORDER BY run) AS prev_run,
               row_number() OVER (PARTITION BY scanner ORDER BY run) AS place
        FROM (SELECT scanner, run, min(run_at) AS run_at FROM members GROUP BY scanner, run)"""),
    "entries": (["members", "runs"], """
        SELECT m.*, r.prev_run, CASE WHEN m.last_seen IS NULL THEN 'fresh' ELSE 'retest' END AS kind
        FROM (SELECT *, lag(run) OVER (PARTITION BY scanner, symbol ORDER BY run) AS last_seen FROM members) m
        JOIN runs r ON r.scanner = m.scanner AND r.run = m.run
        WHERE r.prev_run IS NOT NULL AND (m.last_seen IS NULL OR m.last_seen < r.prev_run)"""),
}


def with_views(names: str, body: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """`body` after the CTEs it names and all they depend on."""
    known = VIEWS | (extra or {})
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in known[name][0]:
            visit(dep)
        if name == "lined":
            visit("ema_steps")
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    plain = ("rules", "signals", "ema_steps")
    ctes = ",\n".join(f"{n} AS {'' if n in plain else 'MATERIALIZED '}({known[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"

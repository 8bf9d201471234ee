"""Scan snapshots: membership diffs, latest rows, triggers, payloads and ledgers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.keys import beside
from ..functions import dates, text
from ..functions.numbers import to_number
from ..operators import keys, membership
from ..operators.signals import latest_known
from ..sources import scans, standin
from .base import query, with_views

KEY = ["scanner", "symbol", "run"]

# Nested snapshots: users folded into 8 symbols.
NESTED = {
    "folded": ([], """
        SELECT event_type AS scanner, user_id % 8 AS symbol, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS run
        FROM events GROUP BY ALL"""),
    "sets": (["folded"], """
        SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY run) AS idx, lead(run) OVER (PARTITION BY scanner ORDER BY run) AS next_run,
               lead(s) OVER (PARTITION BY scanner ORDER BY run) AS next_s
        FROM (SELECT scanner, run, list(symbol) AS s FROM folded GROUP BY scanner, run)"""),
    "walk": (["sets"], """
        SELECT scanner, idx, run, run AS base_run, s AS base_s, next_run, false AS half FROM sets WHERE idx = 1
        UNION ALL
        SELECT scanner, idx, run, CASE WHEN half THEN base_run ELSE run END, CASE WHEN half THEN base_s ELSE s END, next_run, half
        FROM (SELECT w.scanner, n.idx, n.run, n.s, n.next_run, w.base_run, w.base_s,
                     coalesce(list_has_all(w.base_s, n.s) AND len(n.s) < len(w.base_s) AND n.next_run - n.run <= 1
                              AND list_has_all(list_concat(n.s, n.next_s), w.base_s), false) AS half
              FROM walk w JOIN sets n ON n.scanner = w.scanner AND n.idx = w.idx + 1)"""),
}


@query("new_members", "J11 J13 U4 T1", with_views("entries", "SELECT scanner, symbol, run, prev_run FROM entries"))
def new_members(spark, sf):
    return membership.entries(standin.members(spark, sf)).select("scanner", "symbol", "run", "prev_run")


@query("fresh_retest", "J12 T2 K3", with_views("entries", """
SELECT scanner, run, count(*) FILTER (WHERE kind = 'fresh') AS fresh, count(*) FILTER (WHERE kind = 'retest') AS retest
FROM entries GROUP BY scanner, run"""))
def fresh_retest(spark, sf):
    out = membership.entries(standin.members(spark, sf))
    return out.groupBy("scanner", "run").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("fresh", "retest")]
    )


@query("partial_runs", "J27 W20 T3", with_views("walk", """
SELECT scanner, run, base_run, next_run FROM walk WHERE half""", NESTED))
def partial_runs(spark, sf):
    return membership.partial_reads(standin.members(spark, sf, symbols=8), max_gap_hours=6.0)


@query("false_entries", "J27 K11", with_views("walk folded", """
SELECT w.scanner, w.next_run AS run, b.symbol FROM walk w JOIN folded b ON b.scanner = w.scanner AND b.run = w.base_run
WHERE w.half AND NOT EXISTS (SELECT 1 FROM folded f WHERE f.scanner = w.scanner AND f.run = w.run AND f.symbol = b.symbol)""", NESTED))
def false_entries(spark, sf):
    members = standin.members(spark, sf, symbols=8)
    return membership.false_entries(members, membership.partial_reads(members, max_gap_hours=6.0))


@query("repaired_members", "K11 J27", with_views("walk folded", """
SELECT scanner, count(*) AS rows_left, count(DISTINCT run) AS runs_left FROM folded f
WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.half AND w.scanner = f.scanner AND w.run = f.run) GROUP BY scanner""", NESTED))
def repaired_members(spark, sf):
    members = standin.members(spark, sf, symbols=8)
    left = membership.repaired(members, membership.partial_reads(members, max_gap_hours=6.0))
    # Runs first: a distinct count per scanner then sees one row per run.
    per_run = left.groupBy("scanner", "run").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("scanner").agg(F.sum("n").alias("rows_left"), F.count(F.lit(1)).alias("runs_left"))


@query("trigger_lookup", "J15 J18 W12 W13", with_views("members entries", """
SELECT k.scanner, k.symbol, coalesce(b.value, f.value) AS trigger, coalesce(b.run_at, f.run_at) AS seen_at, b.run_at IS NOT NULL AS by_breakout
FROM (SELECT DISTINCT scanner, symbol FROM members) k
LEFT JOIN (SELECT scanner, symbol, arg_max(value, run) AS value, max(run_at) AS run_at FROM entries GROUP BY ALL) b USING (scanner, symbol)
LEFT JOIN (SELECT scanner, symbol, arg_min(value, run) AS value, min(run_at) AS run_at FROM members GROUP BY ALL) f USING (scanner, symbol)"""))
def trigger_lookup(spark, sf):
    members = standin.members(spark, sf)
    latest = keys.latest_values(membership.entries(members), ["scanner", "symbol"], ["run"], ["value", "run_at"])
    first = keys.earliest_values(members, ["scanner", "symbol"], ["run"], ["value", "run_at"])
    joined = first.alias("f").join(latest.alias("b"), ["scanner", "symbol"], "left")
    return joined.select(
        "scanner", "symbol", F.coalesce("b.value", "f.value").alias("trigger"),
        F.coalesce("b.run_at", "f.run_at").alias("seen_at"), F.col("b.run_at").isNotNull().alias("by_breakout"),
    )


@query("latest_rows", "W12 L4", with_views("members", """
SELECT scanner, symbol, max(run) AS run, arg_max(value, run) AS value, arg_max(seen_at, run) AS seen_at FROM members GROUP BY ALL"""))
def latest_rows(spark, sf):
    return keys.latest_values(standin.members(spark, sf), ["scanner", "symbol"], ["run"], ["run", "value", "seen_at"])


@query("on_scan_now", "J17 J24", with_views("members", """
SELECT scanner, symbol, bool_or(run = (SELECT max(run) FROM members)) AS on_scan FROM members GROUP BY ALL"""))
def on_scan_now(spark, sf):
    members = standin.members(spark, sf)
    newest = standin.table(spark, sf, "events").agg(F.floor(F.unix_timestamp(F.max("ts")) / 21600).cast("long").alias("newest"))
    # One row: the latest run.
    flagged = members.transform(beside, newest)
    return flagged.groupBy("scanner", "symbol").agg(F.bool_or(F.col("run") == F.col("newest")).alias("on_scan"))


@query("recent_runs", "W20", with_views("members", """
SELECT scanner, run, n FROM (SELECT scanner, run, count(*) AS n, row_number() OVER (PARTITION BY scanner ORDER BY run DESC) AS k
                             FROM members GROUP BY scanner, run) WHERE k <= 60"""))
def recent_runs(spark, sf):
    per_run = standin.members(spark, sf).groupBy("scanner", "run").agg(F.count(F.lit(1)).alias("n"))
    return keys.pick_per_key(per_run, ["scanner"], [F.desc("run")], 60)


@query("recent_breakouts", "S16 L1 E13", with_views("entries", """
SELECT scanner, symbol, kind, run_at AS detected_at, value, json_extract_string(props, '$.k') AS k FROM entries
WHERE run_at >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY"""))
def recent_breakouts(spark, sf):
    newest = standin.table(spark, sf, "events").agg(F.max("ts").alias("newest"))
    found = membership.entries(standin.members(spark, sf)).transform(beside, newest)
    recent = found.where(F.col("run_at") >= F.expr("newest - INTERVAL 10 DAYS"))
    return recent.select(
        "scanner", "symbol", "kind", F.col("run_at").alias("detected_at"), "value",
        text.payload_cells(F.col("props"))["k"].alias("k"),
    ).orderBy(F.desc("detected_at"), "scanner", "symbol")


@query("payload_cells", "S8 S7 C1 R2 R3 F11 C5 C6", """
SELECT event_id, symbol, price, k, filled, filled >= 3 AS is_stock, row_text
FROM (SELECT event_id, 'U' || user_id AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
             3 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS filled,
             'U' || user_id || '|' || event_type || '|' || CAST(user_id AS VARCHAR) AS row_text FROM events)""")
def payload_cells(spark, sf):
    events = standin.table(spark, sf, "events")
    # A scanned table as the page shows it: header cells with a sort hint on a second line, price as text.
    headers = F.array(
        F.lit("Sr."), F.lit("Symbol"), F.lit("Price\nSort table by Price"), F.lit("Industry"), F.lit("Note")
    )
    cells = F.array(
        F.col("user_id").cast("string"), F.concat(F.lit(" u"), F.col("user_id")),
        F.concat(F.format_string("%.2f", "value"), F.lit(" %")), F.col("event_type"),
        F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("seen")), F.lit("ragged"),
    )
    rows = events.select("event_id", "props", "user_id", "event_type", headers.alias("headers"), cells.alias("cells"))
    mapped = rows.withColumn("row", text.scanned_row(F.col("headers"), F.col("cells")))
    stored = mapped.withColumn("payload", F.to_json("row"))
    entries = scans.payload_entries(F.col("payload"))
    out = stored.withColumns({"e": entries, "clean": text.payload_cells(F.col("payload"))})
    clean = F.col("clean")
    return out.select(
        "event_id", clean["_symbol"].alias("symbol"), to_number(text.cell_by_keyword(F.col("e"), "price")).alias("price"),
        to_number(text.payload_cells(F.col("props"))["k"]).alias("k"),
        (text.nonblank_cells(clean) - 1).alias("filled"),
        ((text.nonblank_cells(clean) - 1) >= 3).alias("is_stock"),
        F.concat_ws("|", clean["_symbol"], clean["Industry"], clean["Sr."]).alias("row_text"),
    )


@query("table_names", "F22 F26", """
SELECT snapshot, position, title, known > 0 AND known = kinds AS trusted,
       CASE WHEN known > 0 AND known = kinds THEN CASE WHEN hit THEN title END
            WHEN tables = 3 THEN ['click', 'view', 'purchase'][position] ELSE title END AS scanner
FROM (SELECT *, count(*) OVER w AS tables, count(CASE WHEN hit THEN title END) OVER w AS known,
             list_unique(list(CASE WHEN hit THEN title END) OVER w) AS kinds
      FROM (SELECT snapshot, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY first_at) AS INTEGER) AS position, title, title IN ('click', 'view', 'purchase') AS hit
            FROM (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) AS snapshot, min(event_id) AS first_at,
                         CASE WHEN user_id % 4 = 0 THEN event_type ELSE 'Scanner ' || (user_id % 4) END AS title
                  FROM events GROUP BY snapshot, title, user_id % 9))
      WINDOW w AS (PARTITION BY snapshot))""")
def table_names(spark, sf):
    events = standin.table(spark, sf, "events")
    title = F.when(F.col("user_id") % 4 == 0, F.col("event_type")).otherwise(
        F.concat(F.lit("Scanner "), (F.col("user_id") % 4).cast("string"))
    )
    snapshot = F.floor(F.unix_timestamp("ts") / 1800).cast("long")
    tables = events.groupBy(snapshot.alias("snapshot"), title.alias("title"), (F.col("user_id") % 9).alias("part")).agg(
        F.min("event_id").alias("first_at")
    )
    place = F.row_number().over(W.partitionBy("snapshot").orderBy("first_at")).cast("int")
    known = ["click", "view", "purchase"]
    titled = scans.trusted_titles(tables.withColumn("position", place), known)
    return scans.names_by_position(titled, known).select("snapshot", "position", "title", "trusted", "scanner")


@query("live_hits", "E22 D2 J14 S14", with_views("entries hits1", """
SELECT scanner, e.symbol, CASE WHEN strftime(run_at + INTERVAL 330 MINUTE, '%H:%M') < '09:15'
            THEN CAST(run_at + INTERVAL 330 MINUTE AS DATE) - 1 ELSE CAST(run_at + INTERVAL 330 MINUTE AS DATE) END AS hit_date,
       coalesce(k.tier, '') AS tier, coalesce(k.sector, '') AS sector, 'live' AS source
FROM entries e LEFT JOIN (SELECT symbol, last(tier ORDER BY hit_date, tier, sector) AS tier, last(sector ORDER BY hit_date, tier, sector) AS sector
                          FROM hits1 WHERE tier <> '' GROUP BY symbol) k ON k.symbol = e.symbol"""))
def live_hits(spark, sf):
    found = membership.entries(standin.members(spark, sf))
    known = latest_known(standin.hits(spark, sf))
    return found.join(known, "symbol", "left").select(
        "scanner", "symbol", dates.session_date(F.col("run_at")).alias("hit_date"),
        F.coalesce("tier", F.lit("")).alias("tier"), F.coalesce("sector", F.lit("")).alias("sector"),
        F.lit("live").alias("source"),
    )


@query("slot_marks", "D6 K9 T8", """
SELECT slot, min(event_id) AS first_event, count(*) AS events FROM (
    SELECT event_id, CASE WHEN isodow(l) < 6 AND hm >= '10:00' AND hm < '20:00'
                          THEN strftime(l, '%Y-%m-%d') || ' ' || CASE WHEN hm < '13:00' THEN '10:00' WHEN hm < '15:00' THEN '13:00' ELSE '15:00' END END AS slot
    FROM (SELECT *, strftime(l, '%H:%M') AS hm FROM (SELECT *, ts + INTERVAL 330 MINUTE AS l FROM events))) WHERE slot IS NOT NULL GROUP BY slot""")
def slot_marks(spark, sf):
    events = standin.table(spark, sf, "events")
    slotted = events.select("event_id", dates.slot_of(dates.local_time(F.col("ts"))).alias("slot"))
    return slotted.where(F.col("slot").isNotNull()).groupBy("slot").agg(
        F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("events")
    )


@query("tracked_symbols", "U3 U6 A18 A19", with_views("entries members hits1", """
SELECT symbol FROM entries WHERE run_at >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY
UNION SELECT symbol FROM members WHERE run = (SELECT max(run) FROM members)
UNION SELECT symbol FROM hits1 WHERE hit_date >= (SELECT max(hit_date) FROM hits1) - INTERVAL 120 DAY"""))
def tracked_symbols(spark, sf):
    members = standin.members(spark, sf)
    newest = standin.table(spark, sf, "events").agg(F.max("ts").alias("newest"))
    hits = standin.hits(spark, sf).select("symbol", "hit_date")
    last = standin.table(spark, sf, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("last"))
    fresh = membership.entries(members).transform(beside, newest).where("run_at >= newest - INTERVAL 5 DAYS")
    current = members.transform(beside, newest).where(
        F.col("run") == F.floor(F.unix_timestamp("newest") / 21600)
    )
    picked = hits.transform(beside, last).where(F.col("hit_date") >= F.date_sub("last", 120))
    return fresh.select("symbol").union(current.select("symbol")).union(picked.select("symbol")).distinct()


@query("history_start", "U3 A18 D7", with_views("entries hits1", """
SELECT least(CAST(min(run_at) AS DATE) - 9131, (SELECT max(hit_date) - 120 FROM hits1)) - 407 AS start, count(*) AS entries,
       round(date_diff('second', min(run_at), max(run_at)) / 3600.0, 6) AS span_hours FROM entries"""))
def history_start(spark, sf):
    found = membership.entries(standin.members(spark, sf))
    first = found.agg(F.min("run_at").alias("first"), F.max("run_at").alias("last"), F.count(F.lit(1)).alias("entries"))
    picked = standin.hits(spark, sf).agg(F.date_sub(F.max("hit_date"), 120).alias("since"))
    # Two single-row tables.
    both = first.transform(beside, picked)
    start = F.least(F.date_sub(F.to_date("first"), standin.SHIFT_DAYS), F.col("since"))
    return both.select(
        F.date_sub(start, 407).alias("start"), "entries", F.round(dates.age_hours(F.col("last"), F.col("first")), 6).alias("span_hours")
    )


@query("hit_history", "S15 A19", with_views("hits1", """
SELECT scanner, symbol, count(*) AS hits, min(hit_date) AS first, max(hit_date) AS last, string_agg(CAST(hit_date AS VARCHAR), ',' ORDER BY hit_date) AS days
FROM hits1 GROUP BY scanner, symbol"""))
def hit_history(spark, sf):
    # Hits are unique per (scanner, symbol, day), so a history is bounded by the calendar.
    return standin.hits(spark, sf).groupBy("scanner", "symbol").agg(
        F.count(F.lit(1)).alias("hits"), F.min("hit_date").alias("first"), F.max("hit_date").alias("last"),
        F.array_join(F.array_sort(F.collect_set(F.col("hit_date").cast("string"))), ",").alias("days"),
    )


@query("distinct_lists", "A19", with_views("hits1", """
SELECT 'scanner' AS kind, scanner AS name FROM hits1 UNION SELECT 'symbol', CAST(symbol AS VARCHAR) FROM hits1"""))
def distinct_lists(spark, sf):
    hits = standin.hits(spark, sf)
    names = hits.select(F.explode(F.array(
        F.struct(F.lit("scanner").alias("kind"), F.col("scanner").alias("name")),
        F.struct(F.lit("symbol").alias("kind"), F.col("symbol").cast("string").alias("name")),
    )).alias("n"))
    return names.select("n.*").distinct()


@query("vendor_tickers", "C4 C3 L4", """
SELECT s_suppkey AS symbol, code, CASE WHEN code LIKE '^%' THEN code WHEN regexp_full_match(code, '[0-9]+') THEN code || '.BO' ELSE code || '.NS' END AS ticker
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '^' || upper(s_name) WHEN 1 THEN CAST(500000 + s_suppkey AS VARCHAR) ELSE upper(s_name) END AS code FROM supplier)""")
def vendor_tickers(spark, sf):
    s = standin.table(spark, sf, "supplier")
    code = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" ^"), F.col("s_name")))
        .when(F.col("s_suppkey") % 3 == 1, (F.col("s_suppkey") + 500000).cast("string"))
        .otherwise(F.concat(F.col("s_name"), F.lit("  ")))
    )
    coded = s.select(F.col("s_suppkey").alias("symbol"), text.clean_code(code).alias("code"))
    return coded.withColumn("ticker", text.vendor_ticker(F.col("code")))

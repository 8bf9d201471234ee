"""Landed files and written tables: each query writes rows of the given tables, reads them back and compares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sinks import tables
from ..sources import files, scans, standin
from .base import query, with_views


@query("landed_hits", "S1", """
SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS hit_date,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Midcap' ELSE '' END AS tier, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS sector, count(*) AS n
FROM orders GROUP BY ALL""")
def landed_hits(spark, sf):
    """Exports with two kinds of headers: symbol, day and tier, or a byte-order mark, sector, day and symbol."""
    folder = scratch_path(spark, "exports")
    rows = standin.table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "dd-MM-yyyy"))
    even, symbol = F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")
    first, second = rows.where(even).select(symbol, "day", F.lit("Midcap")), rows.where(~even).select("o_orderstatus", "day", symbol)
    for part, header in ((first, ["Symbol", "Date", "Marketcapname"]), (second, ["\ufeffSector", "Date", "Symbol"])):
        part.toDF(*header).write.mode("append").option("header", True).csv(folder)
    return files.hit_exports(spark, folder).groupBy("symbol", "hit_date", "tier", "sector").agg(F.count(F.lit(1)).alias("n"))


@query("event_calendar", "S9", """
SELECT CAST(o_orderkey AS VARCHAR) AS code, CAST(o_custkey AS VARCHAR) AS short_name, o_orderpriority AS name, CAST(o_orderdate AS DATE) AS meeting_date
FROM orders WHERE o_orderkey % 5 <> 0""")
def event_calendar(spark, sf):
    """A calendar of JSON arrays, a hundred order numbers a line; every fifth event has a day that is none."""
    path = scratch_path(spark, "calendar")
    day = F.when(F.col("o_orderkey") % 5 == 0, "to be announced").otherwise(F.date_format("o_orderdate", "dd MMM yyyy"))
    event = F.struct(
        F.concat(F.lit(" "), F.col("o_orderkey")).alias("scrip_Code"), F.concat(F.col("o_custkey").cast("string"), F.lit(" ")).alias("short_name"),
        F.col("o_orderpriority").alias("Long_Name"), day.alias("meeting_date"),
    )
    lines = standin.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.to_json(F.collect_list(event)).alias("value"))
    lines.select("value").write.text(path)
    return files.event_calendar(spark, path, one_document=False)


@query("alert_ledger", "K9 K10 J25 K3", """
SELECT user_id, event_type, CAST(min(ts) AS DATE) AS first_day, 1 AS times FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL
UNION ALL
SELECT user_id, event_type, CAST(min(ts) AS DATE), 1 FROM events n WHERE NOT EXISTS (
    SELECT 1 FROM events o WHERE o.user_id = n.user_id AND o.event_type = n.event_type AND o.ts < TIMESTAMP '2024-01-16') GROUP BY ALL""")
def alert_ledger(spark, sf):
    """A ledger fed with the early events, then all events, then all again: each key is written once ever."""
    path = scratch_path(spark, "ledger")
    rows = standin.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    for feed in (rows.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")), rows, rows):
        tables.append_new(feed, path, ["user_id", "event_type"], ["ts", "event_id"])
    kept = spark.read.parquet(path).groupBy("user_id", "event_type")
    return kept.agg(F.to_date(F.min("ts")).alias("first_day"), F.count(F.lit(1)).cast("int").alias("times"))


@query("mirror_write", "K4", """
SELECT event_type, user_id, count(*) AS n FROM events
WHERE event_type <> (SELECT min(event_type) FROM events) OR user_id % 3 <> 0 GROUP BY ALL""")
def mirror_write(spark, sf):
    """A table partitioned by kind, then one partition made equal to a smaller set; the others stay."""
    path = scratch_path(spark, "mirror")
    rows = standin.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    tables.mirror(rows, path, ["user_id"], "event_type")
    first = rows.agg(F.min("event_type")).first()[0]
    tables.mirror(rows.where((F.col("event_type") == first) & (F.col("user_id") % 3 != 0)), path, ["user_id"], "event_type")
    return spark.read.parquet(path).select("event_type", "user_id", "n")


@query("json_export", "K8 R3", """
SELECT user_id, count(*) AS n, CASE WHEN user_id % 4 = 0 THEN NULL ELSE max(value) END AS best FROM events GROUP BY user_id""")
def json_export(spark, sf):
    """Per-user rows with NaN and infinite numbers, exported as JSON and read back."""
    path = scratch_path(spark, "json")
    best = F.when(F.col("user_id") % 8 == 0, F.lit(float("nan"))).when(F.col("user_id") % 4 == 0, F.lit(float("inf"))).otherwise(F.max("value"))
    rows = standin.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    tables.export_json(rows, path)
    return spark.read.schema("user_id bigint, n bigint, best double").json(path)


@query("newest_export", "S2 S4 S1", """
SELECT 'P' || p_partkey AS code, p_name AS name, DATE '2024-03-01' AS asof FROM part WHERE p_partkey % 4 <> 0""")
def newest_export(spark, sf):
    """Three dated exports with other rows each; the newest one alone is read, with the day in its name."""
    folder = scratch_path(spark, "dated")
    rows = standin.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("Code"), F.col("p_name").alias("Name"), "p_partkey")
    for day, part in (("2024-03-01", F.col("p_partkey") % 4 != 0), ("2023-12-31", F.lit(True)), ("2024-02-29", F.col("p_partkey") % 2 == 0)):
        rows.where(part).drop("p_partkey").write.option("header", True).csv(f"{folder}/{day}-export.csv")
    return files.newest_file_rows(spark, folder).select(F.col("Code").alias("code"), F.col("Name").alias("name"), F.col("__asof").alias("asof"))


@query("landed_bars", "S6 F3", with_views("bars", """
SELECT symbol, date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY symbol) AS INTEGER) AS n_bars,
       round(open, 4) AS open, round(close, 4) AS close
FROM bars WHERE NOT ((symbol + pos) % 11 = 0 OR (symbol + pos) % 13 = 0 OR (symbol + pos) % 17 = 0 OR (symbol + pos) % 19 = 0)"""))
def landed_bars(spark, sf):
    """Bars as a feed lands them: with a time of day, without an open or a close, with a high of zero or a negative low."""
    path = scratch_path(spark, "feed")
    at = F.col("symbol") + F.col("pos")
    landed = standin.bar_table(spark, sf).select(
        "symbol", (F.col("date").cast("timestamp") + F.expr("INTERVAL 9 HOURS")).alias("date"), F.when(at % 11 != 0, F.col("open")).alias("open"),
        F.when(at % 13 == 0, 0.0).otherwise(F.col("high")).alias("high"), F.when(at % 17 == 0, -F.col("low")).otherwise(F.col("low")).alias("low"),
        F.when(at % 19 != 0, F.col("close")).alias("close"), "volume",
    )
    landed.write.parquet(path)
    out = files.bar_table(spark, path)
    return out.select("symbol", "date", "pos", "n_bars", F.round("open", 4).alias("open"), F.round("close", 4).alias("close"))


@query("stock_rows", "F10 S7", """
SELECT event_id, 'U' || user_id AS symbol FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 OR event_id % 7 = 0""")
def stock_rows(spark, sf):
    """Scanned tables whose rows may be a lone notice; rows with fewer than three filled cells go."""
    k, blank = F.col("event_id"), F.lit("  ")
    bare = (k % 7 != 0) & ((k % 3 == 0) | (k % 5 == 0))
    headers = F.array(*[F.lit(h) for h in ("Sr.", "Symbol", "Price", "Note")])
    cells = F.array(
        F.when(k % 3 == 0, blank).otherwise(F.lit("1")), F.concat(F.lit("u"), "user_id"),
        F.when(bare & (k % 5 == 0) | (bare & (k % 3 == 0)), blank).otherwise(F.format_string("%.2f", "value")), F.when(bare, blank).otherwise(F.lit("seen")),
    )
    tables_ = standin.table(spark, sf, "events").select("event_id", headers.alias("headers"), cells.alias("cells"))
    return scans.scan_rows(tables_).select("event_id", "symbol")

"""Table maintenance as data: upserts, inserts, mirrors, cleaning and late columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys
from ..session import scratch_path
from ..sinks import tables
from ..sources import standin
from .base import query, with_views
from .outcomes import HITS2

CUT = "2024-01-16 00:00:00"


def halves(spark, sf):
    rows = standin.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    early = F.col("ts") < F.lit(CUT).cast("timestamp")
    return rows.where(early), rows.where(~early)


@query("upsert_latest", "K1 T4 W12", """
SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, ROW(ts, event_id)) AS event_id, arg_max(value, ROW(ts, event_id)) AS value FROM events GROUP BY ALL""")
def upsert_latest(spark, sf):
    old, new = halves(spark, sf)
    return keys.upsert_latest(old, new, ["user_id", "event_type"], ["ts", "event_id"])


@query("insert_ignore", "K2 K3", f"""
SELECT user_id, day, arg_min(event_id, ROW(ts, event_id)) AS event_id, arg_min(value, ROW(ts, event_id)) AS value FROM (
    SELECT *, CAST(ts AS DATE) + CAST(user_id % 2 * 10 AS INTEGER) AS day FROM events WHERE ts >= TIMESTAMP '{CUT}') n
WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '{CUT}' AND o.user_id = n.user_id AND CAST(o.ts AS DATE) + 15 = n.day) GROUP BY ALL""")
def insert_ignore(spark, sf):
    old, new = halves(spark, sf)
    held = old.select("user_id", F.date_add(F.to_date("ts"), 15).alias("day"))
    rows = new.select("user_id", F.date_add(F.to_date("ts"), (F.col("user_id") % 2 * 10).cast("int")).alias("day"), "ts", "event_id", "value")
    return keys.insert_ignore(held, rows, ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@query("mirror_sync", "K4 U4", with_views("hits1 hits2", """
SELECT scanner, change, count(*) AS n FROM (
    SELECT coalesce(a.scanner, b.scanner) AS scanner, CASE WHEN a.scanner IS NULL THEN 'insert' ELSE 'delete' END AS change
    FROM hits1 a FULL JOIN (SELECT scanner, symbol, hit_date FROM hits2 UNION SELECT scanner, symbol, hit_date FROM hits1 WHERE symbol % 5 <> 0) b ON a.scanner = b.scanner AND a.symbol = b.symbol AND a.hit_date = b.hit_date
    WHERE a.scanner IS NULL OR b.scanner IS NULL) GROUP BY ALL""", HITS2))
def mirror_sync(spark, sf):
    key = ["scanner", "symbol", "hit_date"]
    now = standin.hits(spark, sf)
    wanted = now.where("symbol % 5 <> 0").select(*key).union(standin.hits(spark, sf, "o_orderdate").select(*key))
    return keys.mirror_changes(now, wanted, key).groupBy("scanner", "change").agg(F.count(F.lit(1)).alias("n"))


@query("clean_numbers", "K8 R3", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / (event_id % 3) END AS ratio, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS gap FROM events""")
def clean_numbers(spark, sf):
    k = F.col("event_id")
    infinite = F.when(k % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value") / (k % 3))
    missing = F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return tables.clean_numbers(standin.table(spark, sf, "events").select("event_id", infinite.alias("ratio"), missing.alias("gap")))


@query("late_columns", "K12", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'fresh' ELSE event_type END AS kind, CAST(NULL AS DOUBLE) AS volume FROM events""")
def late_columns(spark, sf):
    rows = standin.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("kind"))
    return tables.with_defaults(rows, {"kind": F.lit("fresh"), "volume": F.lit(None).cast("double")})


@query("csv_export", "K7", """
SELECT user_id, count(*) AS n, min(CAST(ts AS DATE)) AS first, max(value) AS best FROM events GROUP BY user_id""")
def csv_export(spark, sf):
    """Per-user summary written as CSV and read back."""
    path = scratch_path(spark, "csv")
    rows = standin.table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("first"), F.max("value").alias("best")
    )
    tables.export_csv(rows, path)
    return spark.read.schema("user_id bigint, n bigint, first date, best double").option("header", True).csv(path)


@query("calendar_replace", "K5", f"""
SELECT user_id, max(ts) AS fetched_at FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY user_id""")
def calendar_replace(spark, sf):
    """A stored calendar is replaced once it is old enough; an empty or an early refresh changes nothing."""
    path = scratch_path(spark, "calendar")
    old, new = (h.groupBy("user_id").agg(F.max("ts").alias("fetched_at")) for h in halves(spark, sf))
    tables.replace_if_filled(old, path, F.lit(CUT).cast("timestamp"))
    tables.replace_if_filled(new, path, F.lit(CUT).cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
    tables.replace_if_filled(new.where("user_id < 0"), path, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    tables.replace_if_filled(new, path, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return spark.read.parquet(path)

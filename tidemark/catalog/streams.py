"""Streaming jobs over events that arrive in several landings; checks are their batch results.

Events land in time order, cut at points that no run or week ends at, and every thirteenth one only in the last
landing, late by up to the whole span. A job is stopped after each landing and goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators.keys import beside
from ..session import scratch_path
from ..sources import standin
from ..streaming import jobs
from .base import query, with_views
from .snapshots import NESTED

LANDINGS = 6


def over_landings(spark, sf, name: str, job: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Run `job(stream, work)` after each landing; its last result."""
    work = scratch_path(spark, name)
    events = standin.table(spark, sf, "events")
    span = events.agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi"))
    at = (F.unix_timestamp("ts") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)
    landing = F.when(F.col("event_id") % 13 == 0, LANDINGS).otherwise(F.floor(at * (LANDINGS - 0.3))).cast("int")
    placed = events.transform(beside, span).withColumn("landing", landing).drop("lo", "hi")
    out = None
    for k in range(LANDINGS + 1):
        placed.where(F.col("landing") == k).drop("landing").write.mode("append").parquet(f"{work}/landed")
        out = job(jobs.event_stream(spark, f"{work}/landed", "*.parquet", 1000), f"{work}/job")
    return out


def to_members(rows):
    return rows.select(
        F.col("event_type").alias("scanner"), F.col("user_id").alias("symbol"),
        F.floor(F.unix_timestamp("ts") / 21600).cast("long").alias("run"),
    )


@query("stream_new_members", "T1 T2", with_views("entries", "SELECT scanner, symbol, run, prev_run, kind FROM entries"))
def stream_new_members(spark, sf):
    return over_landings(spark, sf, "diff", lambda stream, work: jobs.membership_diff(stream, to_members, work))


@query("settled_entries", "T3 J27", with_views("walk folded", """
SELECT e.scanner, e.symbol, e.run, kind
FROM (SELECT m.scanner, m.symbol, m.run, CASE WHEN last IS NULL THEN 'fresh' ELSE 'retest' END AS kind
      FROM (SELECT *, lag(run) OVER (PARTITION BY scanner, symbol ORDER BY run) AS last FROM folded) m
      JOIN (SELECT scanner, run, lag(run) OVER (PARTITION BY scanner ORDER BY run) AS prev FROM sets) r ON r.scanner = m.scanner AND r.run = m.run
      WHERE prev IS NOT NULL AND (last IS NULL OR last < prev)) e
WHERE (SELECT max(run) FROM folded) - e.run >= 1 AND NOT EXISTS (
    SELECT 1 FROM walk w JOIN folded b ON b.scanner = w.scanner AND b.run = w.base_run
    WHERE w.half AND w.scanner = e.scanner AND w.next_run = e.run AND b.symbol = e.symbol
          AND NOT EXISTS (SELECT 1 FROM folded f WHERE f.scanner = w.scanner AND f.run = w.run AND f.symbol = b.symbol))""", NESTED))
def settled_entries(spark, sf):
    return jobs.settled_entries(standin.members(spark, sf, symbols=8), 6.0).select("scanner", "symbol", "run", "kind")


@query("stream_latest_bars", "T4 K1", """
SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, ROW(ts, event_id)) AS value, max(ts) AS ts, arg_max(event_id, ROW(ts, event_id)) AS event_id FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def stream_latest_bars(spark, sf):
    def job(stream, work):
        rows = stream.select("user_id", F.to_date("ts").alias("day"), "value", "ts", "event_id")
        return jobs.latest_bars(rows, work, ["user_id", "day"], ["ts", "event_id"])

    return over_landings(spark, sf, "bars", job)


@query("stream_closed_weeks", "T5", """
SELECT user_id, week, high, low, n FROM (
    SELECT *, lead(week) OVER (PARTITION BY user_id ORDER BY week) IS NOT NULL AS later FROM (
        SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY ALL))
WHERE later OR (SELECT max(ts) FROM events) >= week + INTERVAL 5 DAY""")
def stream_closed_weeks(spark, sf):
    return over_landings(spark, sf, "weeks", jobs.closed_weeks)


@query("stream_slots_once", "T7 T8", """
SELECT slot FROM (SELECT DISTINCT CASE WHEN isodow(l) < 6 AND hm >= '10:00' AND hm < '20:00' THEN strftime(l, '%Y-%m-%d') || ' ' || CASE WHEN hm < '13:00' THEN '10:00' WHEN hm < '15:00' THEN '13:00' ELSE '15:00' END END AS slot
    FROM (SELECT *, strftime(l, '%H:%M') AS hm FROM (SELECT *, ts + INTERVAL 330 MINUTE AS l FROM events))) WHERE slot IS NOT NULL""")
def stream_slots_once(spark, sf):
    def job(stream, work):
        slotted = stream.select(dates.slot_of(dates.local_time(F.col("ts"))).alias("slot"))
        return jobs.once_only(slotted.where(F.col("slot").isNotNull()), work, ["slot"])

    return over_landings(spark, sf, "slots", job)

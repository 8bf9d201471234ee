"""Event-time jobs over rows that land in slices of time; checks are their batch results.

Some rows of a slice's end land with the next slice, within the jobs' delay. Where a job takes corrections, some rows of
any age land last. A job is stopped after each landing and goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import dates
from ..operators.keys import beside
from ..session import scratch_path
from ..sources import standin
from ..streaming import timed
from .base import query, with_views
from .snapshots import NESTED

LANDINGS = 6
HOURS = 6


def landing(rows: DataFrame, at: str, late: Column, far: Column | None = None, end: float = 0.9) -> DataFrame:
    """Add `landing`: the slice of time, one more for `late` rows of the slice's end, the last for `far` rows."""
    span = rows.agg(F.min(F.unix_timestamp(at)).alias("__lo"), F.max(F.unix_timestamp(at)).alias("__hi"))
    share = (F.unix_timestamp(at) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1) * (LANDINGS - 0.3)
    k = F.floor(share) + (late & (share - F.floor(share) > end)).cast("int")
    placed = rows.transform(beside, span).withColumn("landing", k if far is None else F.when(far, F.lit(LANDINGS)).otherwise(k))
    return placed.drop("__lo", "__hi")


def over_landings(spark: SparkSession, name: str, frames: dict[str, DataFrame], job: Callable[[dict[str, DataFrame], str], DataFrame]) -> DataFrame:
    """Run `job(streams, work)` after each landing; its last result."""
    work = scratch_path(spark, name)
    # Worked out once; a landing reads its own slice.
    for n, rows in frames.items():
        rows.write.partitionBy("landing").parquet(f"{work}/slices/{n}")
    shapes = {n: rows.drop("landing").schema for n, rows in frames.items()}
    out = None
    for k in range(LANDINGS + 1):
        for n, shape in shapes.items():
            sliced = spark.read.schema(StructType([*shape.fields, StructField("landing", LongType())])).parquet(f"{work}/slices/{n}")
            sliced.where(F.col("landing") == k).drop("landing").write.mode("append").parquet(f"{work}/landed/{n}")
        streams = {n: spark.readStream.schema(shape).parquet(f"{work}/landed/{n}") for n, shape in shapes.items()}
        out = job(streams, f"{work}/job")
    return out


def event_landings(spark: SparkSession, sf: str, far: bool = False) -> DataFrame:
    events = standin.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return landing(events, "ts", F.col("event_id") % 13 == 0, (F.col("event_id") % 29 == 0) if far else None)


# The jobs' clock: the newest event less their delay. A run is known to be closed when its end is not after it.
NOW = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"
CLOSED = f"(run + 1) * 21600 <= epoch({NOW})"


@query("stream_entries_once", "T1 T2", with_views("entries", f"SELECT scanner, symbol, run, prev_run, kind FROM entries WHERE {CLOSED}"))
def stream_entries_once(spark, sf):
    def job(streams, work):
        sightings = streams["events"].select(F.col("event_type").alias("scanner"), F.col("user_id").alias("symbol"), "ts")
        return timed.entries_once(sightings, work, HOURS, "1 day")

    return over_landings(spark, "entries", {"events": event_landings(spark, sf)}, job)


@query("stream_settled_entries", "T3 J27", with_views("walk folded", f"""
SELECT e.scanner, e.symbol, e.run, kind, f.symbol IS NOT NULL AS taken_back,
       f.symbol IS NULL AND (epoch({NOW}) - (e.run + 1) * 21600) / 3600 >= 6 AS settled
FROM (SELECT m.scanner, m.symbol, m.run, CASE WHEN last IS NULL THEN 'fresh' ELSE 'retest' END AS kind
      FROM (SELECT *, lag(run) OVER (PARTITION BY scanner, symbol ORDER BY run) AS last FROM folded) m
      JOIN (SELECT scanner, run, lag(run) OVER (PARTITION BY scanner ORDER BY run) AS prev FROM sets) r ON r.scanner = m.scanner AND r.run = m.run
      WHERE prev IS NOT NULL AND (last IS NULL OR last < prev)) e
LEFT JOIN (SELECT w.scanner, w.next_run, b.symbol FROM walk w JOIN folded b ON b.scanner = w.scanner AND b.run = w.base_run
           WHERE w.half AND NOT EXISTS (SELECT 1 FROM folded f WHERE f.scanner = w.scanner AND f.run = w.run AND f.symbol = b.symbol)) f
  ON f.scanner = e.scanner AND f.next_run = e.run AND f.symbol = e.symbol""", NESTED | {"folded": ([], f"SELECT * FROM ({NESTED['folded'][1]}) WHERE {CLOSED}")}))
def stream_settled_entries(spark, sf):
    """Entries of nested snapshots (all users, in 8 symbols), with those that half-read runs made false."""
    def job(streams, work):
        sightings = streams["events"].select(F.col("event_type").alias("scanner"), F.pmod("user_id", F.lit(8)).alias("symbol"), "ts")
        return timed.changelog(sightings, work, HOURS, "1 day", 6.0)

    changes = over_landings(spark, "changes", {"events": event_landings(spark, sf)}, job)
    newest = standin.table(spark, sf, "events").agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    return timed.net_entries(changes.transform(beside, newest), HOURS, F.col("now"), 6.0)


@query("stream_weeks_once", "T5", f"""
SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, max(value) AS high, min(value) AS low, count(*) AS n FROM events
WHERE date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY <= {NOW} GROUP BY ALL""")
def stream_weeks_once(spark, sf):
    return over_landings(spark, "weeks", {"events": event_landings(spark, sf, far=True)}, lambda streams, work: timed.weeks_once(streams["events"], work))


ORDERS = {
    "rests": (["hits1", "bars", "rules"], """
        SELECT *, DATE '1970-01-05' + CAST(7 * (total // 5) + total % 5 AS INTEGER) AS deadline FROM (
            SELECT h.scanner, h.symbol, h.hit_date, b.high AS trigger, 5 * (d // 7) + least(d % 7, 4) + entry_window AS total
            FROM (SELECT *, date_diff('day', DATE '1970-01-05', hit_date) AS d FROM hits1) h JOIN bars b ON b.symbol = h.symbol AND b.date = h.hit_date
                 JOIN rules r ON r.scanner = h.scanner)"""),
    "filled": (["rests", "bars"], """
        SELECT o.scanner, o.symbol, o.hit_date, min(b.date) AS fill_day, arg_min(greatest(b.open, o.trigger), b.date) AS fill
        FROM rests o JOIN bars b ON b.symbol = o.symbol AND b.date > o.hit_date AND b.date <= o.deadline AND b.high > o.trigger GROUP BY ALL"""),
}


@query("stream_resting_orders", "T9 E2 E3", with_views("rests filled bars", """
SELECT o.scanner, o.symbol, o.hit_date, fill_day, round(fill, 4) AS fill,
       CASE WHEN fill_day IS NOT NULL THEN 'filled' WHEN o.hit_date + INTERVAL 186 HOUR < (SELECT max(date) + INTERVAL 12 HOUR - INTERVAL 30 DAY FROM bars) THEN 'expired' ELSE 'waiting' END AS status
FROM rests o LEFT JOIN filled f ON f.scanner = o.scanner AND f.symbol = o.symbol AND f.hit_date = o.hit_date""", ORDERS))
def stream_resting_orders(spark, sf):
    """Every hit as an order at its day's high, placed after the close and good for its scanner's window of business days."""
    bars = standin.bar_table(spark, sf)
    hour = lambda c, h: F.timestamp_seconds(F.unix_timestamp(F.col(c).cast("timestamp")) + h * 3600)
    highs = bars.select("symbol", F.col("date").alias("hit_date"), F.col("high").alias("trigger"))
    deadline = dates.add_workdays(F.col("hit_date"), standin.RULES.value(F.col("scanner"), "window"))
    orders = standin.hits(spark, sf).join(highs, ["symbol", "hit_date"]).select(
        "scanner", "symbol", "hit_date", "trigger", deadline.alias("deadline"), hour("hit_date", 18).alias("placed_at")
    )
    traded = bars.select("symbol", hour("date", 12).alias("bar_at"), "open", "high")

    def parts(rows: DataFrame, at: str) -> DataFrame:
        mix = F.col("symbol") * 7 + F.unix_date(F.to_date(at))
        return landing(rows, at, mix % 13 == 0, mix % 97 == 0, end=0.95)

    frames = {"orders": parts(orders, "placed_at"), "bars": parts(traded, "bar_at")}
    key = ["scanner", "symbol", "hit_date"]
    out = over_landings(spark, "resting", frames, lambda s, work: timed.resting_orders(s["orders"], s["bars"], work, key, "30 days", 7))
    return out.select(*key, "status", F.to_date("fill_at").alias("fill_day"), F.round("fill", 4).alias("fill"))

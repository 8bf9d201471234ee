"""Structured Streaming jobs over event files.

Keyed state lies in disk-backed stores, or in tables written per micro-batch: a replayed
batch reads the same predecessor and overwrites the same output, so results are exact
after a lost executor or driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.keys import beside
from ..operators import membership
from ..sinks import tables

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files: int = 1) -> DataFrame:
    """Events as a file stream, a fixed number of files per micro-batch."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


# Keyed state on disk with a memory bound, whatever it grows to.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # A join's four tables share one store of a task, which is opened and told once per batch and not four times.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def run_to_end(stream: DataFrame, work: str, name: str, handler=None, out: str | None = None) -> None:
    """Process everything that has arrived, then stop. State lies in disk-backed stores."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in DISK_STATE}
    for k, v in DISK_STATE.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{work}/{name}-log").trigger(availableNow=True)
        writer = writer.foreachBatch(handler) if handler else writer.format("parquet").option("path", out).outputMode("append")
        writer.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def membership_diff(stream: DataFrame, to_members, work: str) -> DataFrame:
    """New members of every run of a stream of snapshots, however runs are cut into batches and whenever files come.

    The first sighting of each (scanner, symbol, run) is appended to a table, per batch and so safe to replay. A late
    row can change what later runs mean - a run may gain a predecessor, an entry may turn out seen before - so entries
    are derived from all sightings, not from a last-run state that a late run would not fit.
    """
    members = once_only(to_members(stream), work, ["scanner", "symbol", "run"]).withColumn("run_at", F.col("run"))
    return membership.entries(members).select("scanner", "symbol", "run", "prev_run", "kind")


def settled_entries(members: DataFrame, max_gap_hours: float) -> DataFrame:
    """Entries that can no longer be retracted: half-read runs are taken out first, and entries
    younger than the gap before the newest run wait."""
    partial = membership.partial_reads(members, max_gap_hours)
    clean = membership.repaired(members, partial)
    newest = members.agg(F.max("run_at").alias("newest"))
    found = membership.entries(clean).transform(beside, newest)
    age = (F.unix_timestamp("newest") - F.unix_timestamp("run_at")) / 3600
    return found.where(age >= max_gap_hours).drop("newest")


def latest_bars(stream: DataFrame, work: str, key: list[str], order: list[str]) -> DataFrame:
    """Stored bars where a later version of a key replaces the earlier one; a batch rewrites the buckets it meets only."""
    table = f"{work}/bars"
    run_to_end(stream, work, "bars", lambda rows, batch: tables.merge_buckets(rows, table, batch, key, order))
    return tables.read_buckets(stream.sparkSession, table, stream.schema)


def closed_weeks(stream: DataFrame, work: str) -> DataFrame:
    """Monday-based weekly bars per user, published once the user's week is over; late rows correct them.

    A week is over after its Friday's end on the stream's clock (the newest event) or once the user has an event of a
    later week. Each batch appends its own partial week rows (mergeable extremes, counts, last times), so a late file
    adds to its week instead of being dropped.
    """
    spark = stream.sparkSession
    week = F.date_trunc("week", "ts")

    def step(rows: DataFrame, batch: int) -> None:
        part = rows.groupBy("user_id", week.alias("week")).agg(
            F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")
        )
        part.write.mode("overwrite").parquet(f"{work}/parts/{batch}")

    run_to_end(stream, work, "weeks", step)
    shape = "user_id bigint, week timestamp, high double, low double, n bigint, last timestamp"
    parts = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(f"{work}/parts")
    weeks = parts.groupBy("user_id", "week").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"))
    later = F.lead("week").over(W.partitionBy("user_id").orderBy("week")).isNotNull()
    told = weeks.withColumn("later", later).transform(beside, parts.agg(F.max("last").alias("newest")))
    return told.where("later OR newest >= week + INTERVAL 5 DAYS").select("user_id", "week", "high", "low", "n")


def once_only(stream: DataFrame, work: str, key: list[str]) -> DataFrame:
    """Each key once ever, however late or far apart its events come: exactly-once alerts and slots.

    A keyed store on disk that never expires knows the keys that were told; a batch looks up its own keys only. The
    sink counts a batch's files once, so a replayed batch tells nothing twice.
    """
    keys = stream.select(*key)
    run_to_end(keys.dropDuplicates(key), work, "keys", out=f"{work}/keys")
    return stream.sparkSession.read.schema(keys.schema).parquet(f"{work}/keys")

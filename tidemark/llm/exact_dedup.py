"""Exact deduplication as a stateful stream.

A file stream of (digest, stable id, length, content locator) feeds one keyed aggregation
whose state lives on disk (RocksDB) under the checkpoint and never expires. The state keeps
one entry per digest: the best row so far (longest original, then smallest id, then first
locator) and the number of rows seen. Texts stay in their table; the locator (file, row)
finds them again. Every hit - a row whose digest another row holds - is compared with the
retained row byte by byte, and rows of one digest that differ are grouped by their bytes.

The digest partial-aggregates before the shuffle, so a text with a third of all rows sends
one row per task. Joins on a digest are plain equality joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import BLANK, blank_if_null, located, stored

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every partition's store sets 4 MB of disk aside for its manifest alone.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str | Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(blank_if_null(text), BLANK, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _disk_state(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def absorb(spark: SparkSession, feed: str, checkpoint: str, schema, batches: int) -> DataFrame:
    """Run the stream over what lies in `feed` and return its state: `digest`, `best`, `n`.

    A second call with the same folders reads only files that came since, against the same state.
    """
    # Whole listing in about `batches` triggers, however large the feed is.
    per_batch = -(-len(spark.read.schema(schema).parquet(feed).inputFiles()) // batches)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, per_batch)).parquet(feed)
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "__file", "__row"))
    groups = stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    with _disk_state(spark):
        run = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", checkpoint).load()
    held, seen = state.schema["value"].dataType.names
    return state.select("key.digest", F.col(f"value.{held}").alias("best"), F.col(f"value.{seen}").alias("n"))


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, digest, `__file`, `__row`.

    Texts are equal when they agree after deleting white space; NULL and empty texts are equal to
    each other. Of equal texts the longest original stays, then the smallest id (NULL ids last), then
    the first place in the table, so of rows repeated in full exactly one stays. Other columns are ignored.
    An empty table gives an empty result. `digest` may be weak: results never depend on it.
    """
    spark = docs.sparkSession
    placed = located(docs.select(key, text)) if key != text else located(docs)
    rows = placed.select(
        F.col(key).alias("id"), digest(normalised(text)).alias("digest"), F.char_length(blank_if_null(text)).cast("long").alias("n_chars"), "__file", "__row"
    )
    feed = scratch_path(spark, "dedup-feed")
    rows.write.parquet(feed)
    groups = stored(absorb(spark, feed, scratch_path(spark, "dedup-state"), rows.schema, batches), "dedup-groups")
    rows = spark.read.schema(rows.schema).parquet(feed)
    found = rows.join(groups, "digest")
    decided = _decisions(found)
    shared = found.where("n > 1").select("digest", "__file", "__row", _is_best().alias("first"))
    # Full bytes: texts of rows that share a digest, each beside the one its digest retains.
    texts = stored(placed.select("__file", "__row", normalised(text).alias("bytes")).join(shared, ["__file", "__row"]), "dedup-shared")
    kept = texts.where("first").select("digest", F.col("bytes").alias("kept_bytes"))
    other = texts.where("not first").join(kept, "digest").where(F.col("bytes") != F.col("kept_bytes")).select("digest")
    # Written as it comes: an aggregation here would keep the join from splitting a digest that many rows share.
    clash = stored(other, "dedup-clash").distinct()
    if clash.isEmpty():
        return decided
    apart = texts.join(clash, "digest", "left_semi").join(rows.drop("digest"), ["__file", "__row"])
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "__file", "__row"))
    regrouped = apart.groupBy("bytes").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    again = _decisions(apart.drop("first").join(regrouped, "bytes"))
    return decided.join(clash, "digest", "left_anti").unionByName(again)


def _is_best() -> Column:
    return (F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row"))


def _decisions(found: DataFrame) -> DataFrame:
    return found.select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), _is_best().alias("kept"), "digest", "__file", "__row")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    placed = located(docs)
    # Places of `docs` are the same for both reads; a frame that had to be landed is decided on its landed copy.
    base = placed.drop("__file", "__row")
    gone = dedup(base, key, text).where("not kept").select("__file", "__row")
    return placed.join(gone, ["__file", "__row"], "left_anti").select(*docs.columns)

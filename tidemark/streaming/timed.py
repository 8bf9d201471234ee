"""Event-time jobs whose state is bounded: by watermarks, by keys, or by a tail of undecided runs.

State lies in disk-backed stores. Every job sees its rows through `routed`, which keeps the job's own clock and sets
rows aside that come after what they belong to has closed; these become corrections, so no row is lost to a watermark.
What a batch writes goes to a folder of its own, named by the batch, so a replay writes the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..operators import membership
from ..operators.keys import earliest_values
from ..session import cut
from ..sinks.tables import exists, remove, subfolders
from .jobs import run_to_end

MONDAY = "4 days"  # from the epoch's Thursday to the first Monday
SLOTS = 256  # of a scanner's symbols, each a group of the keyed store


def _before(clock, delay: str) -> Column:
    return F.lit(clock).cast("timestamp") - F.expr(f"INTERVAL {delay}")


def batches(spark: SparkSession, folder: str, before: int | None = None) -> list[int]:
    """Numbers of the batches that have a folder, those of `before` and later left out."""
    return [n for n in subfolders(spark, folder) if before is None or n < before]


def carried(spark: SparkSession, folder: str, batch: int, shape: StructType) -> DataFrame:
    """What the newest batch before this one left in `folder`, no rows where none did; older ones are removed."""
    known = batches(spark, folder, batch)
    for old in known[:-1]:
        remove(spark, f"{folder}/{old}")
    return spark.read.schema(shape).parquet(f"{folder}/{known[-1]}") if known else spark.createDataFrame([], shape)


def _split(shape: StructType) -> StructType:
    """Columns of routed rows: those of the stream, the batch and whether the row is late."""
    return StructType([*shape.fields, StructField("__batch", IntegerType()), StructField("__late", BooleanType())])


def clock(spark: SparkSession, work: str, before: int | None = None):
    """The newest event time of all batches, or of those before one; None before the first."""
    known = batches(spark, f"{work}/clock", before)
    return spark.read.schema("newest timestamp").parquet(f"{work}/clock/{known[-1]}").first()["newest"] if known else None


def routed(stream: DataFrame, work: str, at: str, until: Column, delay: str) -> tuple[DataFrame, DataFrame, object]:
    """Rows of a stream in time (as a stream again), rows too late (as a table), and the newest event time so far.

    A row is too late when `until`, the end of what it belongs to, is not after the newest time of the batches before
    its own minus `delay`. A watermark of `delay` over the rows in time is never ahead of that, so it drops none of
    them. Rows without a time are in time; event-time windows leave them out.
    """
    spark = stream.sparkSession
    shape = stream.schema

    def step(rows: DataFrame, batch: int) -> None:
        before = clock(spark, work, batch)
        late = F.coalesce(until <= _before(before, delay), F.lit(False)) if before else F.lit(False)
        path = f"{work}/routed/__batch={batch}"
        rows.withColumn("__late", late).write.mode("overwrite").partitionBy("__late").parquet(path)
        newest = spark.read.schema(shape).parquet(path).agg(F.greatest(F.max(at), F.lit(before).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{work}/clock/{batch}")
        for old in batches(spark, f"{work}/clock", batch)[:-1]:
            remove(spark, f"{work}/clock/{old}")

    run_to_end(stream, work, "router", step)
    in_time = spark.readStream.schema(_split(shape)).parquet(f"{work}/routed").where("NOT __late").select(*stream.columns)
    late = spark.read.schema(_split(shape)).parquet(f"{work}/routed").where("__late").select(*stream.columns)
    return in_time, late, clock(spark, work)


def state_of(spark: SparkSession, checkpoint: str, operator: int = 0, variable: str | None = None) -> DataFrame:
    """The rows that a job's store holds, by the state reader; a map's entries with their own key beside that of the group."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator)
    held = (reader.option("stateVarName", variable) if variable else reader).load()
    if "user_map_key" not in held.columns:
        return held
    return held.select(F.struct("key.*", "user_map_key.*").alias("key"), F.col("user_map_value").alias("value"))


def weeks_once(stream: DataFrame, work: str, delay: str = "1 day") -> DataFrame:
    """Monday-based weekly bars per user, each published once when the watermark passes the week's end.

    A week's state goes when it closes. Later rows become partial weeks of a correction table, and the bars that are
    read are published weeks merged with their corrections; a closed week that only late rows belong to is there too.
    """
    spark = stream.sparkSession
    monday = F.date_trunc("week", "ts")
    in_time, late, newest = routed(stream, work, "ts", monday + F.expr("INTERVAL 7 DAYS"), delay)

    def bar(rows: DataFrame, week: Column) -> DataFrame:
        return rows.groupBy("user_id", week).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))

    weekly = bar(in_time.withWatermark("ts", delay), F.window("ts", "7 days", startTime=MONDAY))
    run_to_end(weekly.select("user_id", F.col("window.start").alias("week"), "high", "low", "n"), work, "weeks", out=f"{work}/weeks")
    published = spark.read.schema("user_id bigint, week timestamp, high double, low double, n bigint").parquet(f"{work}/weeks")
    parts = published.unionByName(bar(late.where("ts IS NOT NULL"), monday.alias("week")))
    return parts.groupBy("user_id", "week").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"))


def _run_of(ts: Column, hours: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / (hours * 3600)).cast("long")


def _run_at(hours: int, run: Column) -> Column:
    return F.timestamp_seconds(run * (hours * 3600))


class LastRun(StatefulProcessor):
    """Per scanner and slot of symbols: the last run that held each symbol. Gives every run the one before, and keeps nothing else.

    A call costs far more than a look-up in the store, so a symbol is an entry of its slot's map and not a call of its own.
    """

    def __init__(self, symbol: str) -> None:
        self.symbol = symbol

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", f"symbol {self.symbol}", "run long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        runs: dict = {}
        for row in rows:
            runs.setdefault(row["symbol"], []).append(row["run"])
        for symbol, held in runs.items():
            before = self.last.getValue((symbol,))
            last = before[0] if before else None
            for run in sorted(held):
                yield Row(scanner=key[0], symbol=symbol, run=run, last_run=last)
                last = run
            self.last.updateValue((symbol,), (last,))

    def close(self) -> None:
        pass


def closed_members(in_time: DataFrame, hours: int, delay: str) -> DataFrame:
    """Members of closed runs with the run that last held them, as a stream: scanner, symbol, run, last_run.

    A run is a window of `hours`; it is told once, whole, when the watermark passes its end, and runs come in order.
    """
    span = F.window("ts", f"{hours} hours")
    closed = in_time.withWatermark("ts", delay).groupBy(span, "scanner", "symbol").agg(F.count(F.lit(1)).alias("n"))
    slot = F.pmod(F.xxhash64("symbol"), F.lit(SLOTS)).alias("slot")
    keyed = closed.select("scanner", slot, "symbol", _run_of(F.col("window.start"), hours).alias("run")).groupBy("scanner", "slot")
    kinds = {f.name: f.dataType.simpleString() for f in in_time.schema}
    out = f"scanner {kinds['scanner']}, symbol {kinds['symbol']}, run long, last_run long"
    return keyed.transformWithState(LastRun(kinds["symbol"]), out, "append", "none")


def _told(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """What all batches wrote; no rows before the first that had any."""
    if not exists(spark, folder):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("recursiveFileLookup", True).parquet(folder)


def entries_once(stream: DataFrame, work: str, hours: int, delay: str) -> DataFrame:
    """Entries of closed runs, each told once: scanner, symbol, run, prev_run, kind (`fresh` or `retest`).

    A batch meets the keyed store for what its own rows held last and a table of one row per scanner for the run before;
    sightings of earlier batches are not read again. Rows after their run has closed stay in the router's table.
    """
    spark = stream.sparkSession
    in_time, _, _ = routed(stream, work, "ts", _run_at(hours, _run_of(F.col("ts"), hours) + 1), delay)
    sightings = closed_members(in_time, hours, delay)
    known = sightings.select("scanner", "run").schema

    def step(rows: DataFrame, batch: int) -> None:
        seen = cut(rows)
        if seen.isEmpty():
            return
        last = carried(spark, f"{work}/last", batch, known)
        runs = last.unionByName(seen.select("scanner", "run").distinct())
        paired = runs.withColumn("prev_run", F.lag("run").over(membership.of_scanner()))
        absent = F.col("last_run").isNull() | (F.col("last_run") < F.col("prev_run"))
        found = seen.join(paired, ["scanner", "run"]).where(F.col("prev_run").isNotNull() & absent)
        kind = F.when(F.col("last_run").isNull(), "fresh").otherwise("retest")
        found.select("scanner", "symbol", "run", "prev_run", kind.alias("kind")).write.mode("overwrite").parquet(f"{work}/entries/{batch}")
        runs.groupBy("scanner").agg(F.max("run").alias("run")).write.mode("overwrite").parquet(f"{work}/last/{batch}")

    run_to_end(sightings, work, "members", step)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sightings.schema if f.name != "last_run") + ", prev_run long, kind string"
    return _told(spark, f"{work}/entries", out)


def changelog(stream: DataFrame, work: str, hours: int, delay: str, max_gap_hours: float) -> DataFrame:
    """Entries of every closed run as +1 rows and their retractions as -1 rows: scanner, symbol, run, kind, op.

    `stream`: sightings (scanner, symbol, ts). A run's entries are its members that the scanner's run before did not
    hold: `fresh` when the scanner never held them, else `retest`. When a run turns out half-read - a strict part of
    its base whose missing members are all back in the next run, within the gap - the next run's entries that the base
    held are taken back. A batch compares its own runs with the last run of each scanner and that run's base, which are
    all the members that are kept; a symbol's past is one run number in the keyed store. Rows after their run has
    closed are set aside in the router's table and change nothing.
    """
    spark = stream.sparkSession
    in_time, _, _ = routed(stream, work, "ts", _run_at(hours, _run_of(F.col("ts"), hours) + 1), delay)
    sightings = closed_members(in_time, hours, delay)
    names = ["scanner", "symbol", "run", "run_at"]
    shape = sightings.select("scanner", "symbol", "run", _run_at(hours, F.col("run")).alias("run_at")).schema

    def step(rows: DataFrame, batch: int) -> None:
        seen = cut(rows.withColumn("run_at", _run_at(hours, F.col("run"))))
        if seen.isEmpty():
            return
        tail = carried(spark, f"{work}/tail", batch, shape)
        members = cut(tail.unionByName(seen.select(*names)))
        runs = members.groupBy("scanner", "run").agg(F.min("run_at").alias("run_at"))
        runs = runs.withColumn("prev_run", F.lag("run").over(membership.of_scanner()))
        partial = cut(membership.partial_reads(members, max_gap_hours))
        half = partial.select("scanner", "run", F.lit(True).alias("half"))
        # The run before is the newest known one, read half or not; the tail holds it, and so it holds the first one's base.
        absent = F.col("last_run").isNull() | (F.col("last_run") < F.col("prev_run"))
        found = seen.join(runs.select("scanner", "run", "prev_run"), ["scanner", "run"]).where(F.col("prev_run").isNotNull() & absent)
        plus = found.select("scanner", "symbol", "run", F.when(F.col("last_run").isNull(), "fresh").otherwise("retest").alias("kind"), F.lit(1).alias("op"))
        false = membership.false_entries(members, partial).select("scanner", "symbol", "run", F.lit("retest").alias("kind"), F.lit(-1).alias("op"))
        plus.unionByName(false).write.mode("overwrite").parquet(f"{work}/changes/{batch}")
        last = W.partitionBy("scanner").orderBy(F.desc("run"))
        whole = runs.join(half, ["scanner", "run"], "left").withColumn("place", F.row_number().over(last))
        # Whether the last run was half-read is open until the next one comes; its base is the last whole run before it.
        bases = whole.where("place > 1 AND half IS NULL").groupBy("scanner").agg(F.max("run").alias("run"))
        kept = whole.where("place = 1").select("scanner", "run").unionByName(bases)
        members.join(kept, ["scanner", "run"], "left_semi").select(*names).write.mode("overwrite").parquet(f"{work}/tail/{batch}")

    run_to_end(sightings, work, "members", step)
    out = f"scanner {shape['scanner'].dataType.simpleString()}, symbol {shape['symbol'].dataType.simpleString()}, run long, kind string, op int"
    return _told(spark, f"{work}/changes", out)


def net_entries(changes: DataFrame, hours: int, now: Column, max_gap_hours: float) -> DataFrame:
    """Per entry of a changelog: kind, whether it was taken back, and whether it is settled: kept, and the gap has passed at `now`."""
    kind = F.max(F.when(F.col("op") > 0, F.col("kind"))).alias("kind")
    net = changes.groupBy("scanner", "symbol", "run").agg(kind, (F.sum("op") <= 0).alias("taken_back"), F.max(now).alias("__now"))
    age = (F.unix_timestamp("__now") - F.unix_timestamp(_run_at(hours, F.col("run") + 1))) / 3600
    return net.withColumn("settled", ~F.col("taken_back") & (age >= max_gap_hours)).drop("__now")


def resting_orders(orders: DataFrame, bars: DataFrame, work: str, key: list[str], delay: str, days: int) -> DataFrame:
    """Orders with status (filled, expired or waiting), fill_at and fill. `key` names an order.

    `orders`: key, symbol, placed_at, trigger, deadline (last day); `bars`: symbol, bar_at, open, high. An order is filled by
    the first later bar up to its deadline that trades above its trigger, at the trigger or at the open above it. The
    stream joins both sides within `days` after the order: matches come at once, an order without any comes out with no
    bar when both watermarks have passed its last day, and its state goes. Late orders and bars are joined with all
    landed rows of the other side, and only they are. An order stands in one stretch of `days`, a bar in its own and the
    one before, so both sides meet in the store by symbol and stretch, however long a symbol's past is.
    """
    spark = orders.sparkSession
    placed, late_orders, orders_clock = routed(orders, f"{work}/orders", "placed_at", F.col("placed_at"), delay)
    traded, late_bars, bars_clock = routed(bars, f"{work}/bars", "bar_at", F.col("bar_at"), delay)

    def stretch(at: str) -> Column:
        return F.floor(F.unix_timestamp(at) / (days * 86400))

    def joined(o: DataFrame, b: DataFrame, how: str) -> DataFrame:
        # An order meets the bars of its own stretch of `days` and of the next one, not all of its symbol.
        o = o.withColumn("__stretch", stretch("placed_at")).alias("o")
        b = b.withColumn("__stretch", F.explode(F.array(stretch("bar_at"), stretch("bar_at") - 1))).alias("b")
        within = (F.col("b.bar_at") > F.col("o.placed_at")) & (F.col("b.bar_at") <= F.col("o.placed_at") + F.expr(f"INTERVAL {days} DAYS"))
        touched = (F.to_date("b.bar_at") <= F.col("o.deadline")) & (F.col("b.high") > F.col("o.trigger"))
        at = [F.col("b.bar_at").alias("fill_at"), F.greatest("b.open", "o.trigger").alias("fill")]
        same = (F.col("o.symbol") == F.col("b.symbol")) & (F.col("o.__stretch") == F.col("b.__stretch"))
        return o.join(b, same & within & touched, how).select("o.*", *at).drop("__stretch")

    matched = joined(placed.withWatermark("placed_at", delay), traded.withWatermark("bar_at", delay), "leftOuter")
    shape = matched.withColumn("fill", F.when(F.col("fill_at").isNotNull(), F.col("fill")))
    run_to_end(shape, work, "resting", out=f"{work}/matches")
    found = spark.read.schema(shape.schema).parquet(f"{work}/matches")

    landed = [spark.read.schema(_split(x.schema)).parquet(f"{work}/{n}/routed").select(*x.columns) for x, n in ((orders, "orders"), (bars, "bars"))]
    again = joined(late_orders, landed[1], "inner").unionByName(joined(landed[0], late_bars, "inner"))
    fills = found.where("fill_at IS NOT NULL").unionByName(again)
    first = earliest_values(fills, key, ["fill_at"], ["fill_at", "fill"])
    # Orders that the stream let go without a bar, and orders that it never saw.
    ended = found.where("fill_at IS NULL").select(*key, F.lit(True).alias("ended"), F.lit(False).alias("unseen"))
    ended = ended.unionByName(late_orders.select(*key, F.lit(False).alias("ended"), F.lit(True).alias("unseen")))
    now = min((c for c in (orders_clock, bars_clock) if c), default=None)
    over = F.lit(False) if now is None else F.col("placed_at") + F.expr(f"INTERVAL {days} DAYS") < _before(now, delay)
    rows = landed[0].join(first, key, "left").join(ended, key, "left")
    expired = F.col("ended") | (F.col("unseen") & over)
    status = F.when(F.col("fill_at").isNotNull(), "filled").when(expired, "expired").otherwise("waiting")
    return rows.withColumn("status", status).select(*orders.columns, "status", "fill_at", "fill")

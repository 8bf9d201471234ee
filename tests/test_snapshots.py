"""Snapshot repair, streaming against batch, sinks."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import membership
from tidemark.sinks import tables
from tidemark.streaming import jobs

SCHEMA = "scanner string, symbol string, run bigint, run_at timestamp"


def members(spark, runs):
    base = dt.datetime(2026, 11, 9, 2, 0)
    rows = [("S", s, i, base + dt.timedelta(minutes=m)) for i, (m, symbols) in enumerate(runs) for s in symbols]
    return spark.createDataFrame(rows, SCHEMA)


def test_half_read_run_is_found_and_repaired(spark):
    m = members(spark, [(0, "ABC"), (20, "A"), (40, "ABC")])
    part = membership.partial_reads(m)
    assert [(r.run, r.base_run, r.next_run) for r in part.collect()] == [(1, 0, 2)]
    assert {(r.run, r.symbol) for r in membership.false_entries(m, part).collect()} == {(2, "B"), (2, "C")}
    fixed = membership.repaired(m, part)
    assert membership.partial_reads(fixed).count() == 0
    assert membership.entries(fixed).count() == 0


def test_chain_of_half_reads_uses_the_full_list(spark):
    m = members(spark, [(0, "ABC"), (20, "AB"), (40, "ABC"), (60, "AC"), (80, "A"), (100, "ABC")])
    got = [(r.run, r.base_run) for r in membership.partial_reads(m).orderBy("run").collect()]
    # Run 3 lacks B and run 4 lacks it too, so run 3 is no half-read; run 4 is, against run 3.
    assert got == [(1, 0), (4, 3)]


def test_real_drop_hours_later_is_kept(spark):
    assert membership.partial_reads(members(spark, [(0, "AB"), (180, "A"), (1440, "AB")])).count() == 0


def test_stream_of_several_files_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i * 7 % 11, "ab"[i % 2], float(i), "{}") for i in range(120)]
    events = spark.createDataFrame(rows, jobs.EVENTS)
    for k in range(4):
        events.where((F.col("event_id") >= 30 * k) & (F.col("event_id") < 30 * k + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def to_members(df):
        return df.select(
            F.col("event_type").alias("scanner"), F.col("user_id").alias("symbol"),
            F.floor(F.unix_timestamp("ts") / 21600).cast("long").alias("run"),
        )

    stream = jobs.event_stream(spark, str(tmp_path / "in"), "*.parquet")
    got = jobs.membership_diff(stream, to_members, str(tmp_path / "w"))
    runs = to_members(events).distinct().withColumn("run_at", F.timestamp_seconds(F.col("run") * 21600))
    want = membership.entries(runs)
    cols = ["scanner", "symbol", "run", "kind"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    latest = jobs.latest_bars(stream.select("user_id", "ts", "value"), str(tmp_path / "v"), ["user_id"], ["ts"])
    assert {r.user_id: r.value for r in latest.collect()} == {u: max(float(i) for i in range(120) if i * 7 % 11 == u) for u in range(11)}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("y", 3, "p")], "k string, n int, part string")
    path = str(tmp_path / "t")
    assert tables.append_new(a, path, ["k"], ["n"]).count() == 2
    assert tables.append_new(a, path, ["k"], ["n"]).count() == 0
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 3]
    assert tables.mark_once(a, str(tmp_path / "m"), "k").count() == 2
    assert tables.mark_once(a, str(tmp_path / "m"), "k").count() == 0
    mirror = str(tmp_path / "mirror")
    tables.mirror(a, mirror, ["k", "n"], "part")
    again = a.where("part = 'p' AND n <> 3").unionByName(spark.createDataFrame([("z", 9, "p")], a.schema))
    changes = {(r.part, r.change): r.n for r in tables.mirror(again, mirror, ["k", "n"], "part").collect()}
    assert changes == {("p", "delete"): 1, ("p", "insert"): 1}
    assert sorted(r.n for r in spark.read.parquet(mirror).collect()) == [1, 2, 9]
    stamped = a.withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    cal = str(tmp_path / "cal")
    at = lambda text: F.lit(text).cast("timestamp")
    assert tables.replace_if_filled(stamped, cal, at("2024-01-01 01:00:00"))
    assert not tables.replace_if_filled(stamped, cal, at("2024-01-01 05:00:00"))
    assert not tables.replace_if_filled(stamped.limit(0), cal, at("2024-01-03 00:00:00"))
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "i int, v double")
    tables.export_json(odd, str(tmp_path / "j"))
    assert [r.v for r in spark.read.json(str(tmp_path / "j")).orderBy("i").collect()] == [None, None, 1.5]
    tables.export_csv(a, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3

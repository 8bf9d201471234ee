"""Event-time jobs over landings against plain loops: late rows, bounded state, retractions, replays, bucketed merges."""

import datetime as dt
import os
import shutil

from pyspark.sql import functions as F

from tidemark.sinks import tables
from tidemark.streaming import jobs, timed


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


SEEN = "scanner string, symbol long, ts timestamp"


def runs(spec):
    """Sightings of {run: symbols} by 6-hour runs."""
    return [("s", x, at(run * 6 + 1)) for run, symbols in spec.items() for x in symbols]


def first_run():
    return int((dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds() // 21600)


def test_entries_are_told_once_and_early_rows_not_read_again(spark, tmp_path):
    folder, work, base = str(tmp_path / "in"), str(tmp_path / "work"), first_run()
    landings = [{0: [1, 2], 1: [1]}, {1: [2], 2: [1, 3], 3: [2]}, {4: [2, 3], 9: [7]}]
    got = None
    for k, spec in enumerate(landings):
        got = timed.entries_once(land(spark, folder, runs(spec), SEEN), work, 6, "6 hours")
        if k == 1:
            # Nothing of the first landing is needed any more: what is known of it lies in the state.
            shutil.rmtree(f"{work}/routed/__batch=0")
            shutil.copytree(f"{work}/routed/__batch=1", f"{work}/routed/__batch=0")
            shutil.rmtree(f"{work}/routed/__batch=0/__late=false")
    # Run 1 gets its second member late, but before it closes; run 3 follows run 2 without 1 and 3.
    want = [(2, 3, 1, "fresh"), (3, 2, 2, "retest"), (4, 3, 3, "retest")]
    assert sorted((r.run - base, r.symbol, r.prev_run - base, r.kind) for r in got.collect()) == want
    again = timed.entries_once(spark.readStream.schema(SEEN).parquet(folder), work, 6, "6 hours")
    assert again.count() == 3
    held = timed.state_of(spark, f"{work}/members-log", 0, "last").select("key.symbol", "value.run").collect()
    assert sorted((r.symbol, r.run - base) for r in held) == [(1, 2), (2, 4), (3, 4)]


def test_symbols_share_the_groups_of_the_store(spark, tmp_path):
    folder, work, base = str(tmp_path / "in"), str(tmp_path / "work"), first_run()
    for spec in ({0: [None, *range(600)], 1: range(300)}, {2: [None, *range(599)], 9: [0]}):
        got = timed.entries_once(land(spark, folder, runs(spec), SEEN), work, 6, "6 hours")
    assert {(r.symbol, r.run - base, r.kind) for r in got.collect()} == {(x, 2, "retest") for x in [None, *range(300, 599)]}
    # A call per group and batch, not per symbol.
    held = spark.read.format("statestore").option("path", f"{work}/members-log").option("stateVarName", "last").load()
    assert held.select("key").distinct().count() <= 256
    last = timed.state_of(spark, f"{work}/members-log", 0, "last").select("key.symbol", "value.run").collect()
    assert {r.symbol: r.run - base for r in last} == {x: 0 if x == 599 else 2 for x in [None, *range(600)]}


def test_half_read_runs_take_entries_back(spark, tmp_path):
    folder, work, base = str(tmp_path / "in"), str(tmp_path / "work"), first_run()
    # Runs 2 and 3 are half-read beside run 1, run 5 beside run 4; run 7 comes too long after run 6 for that.
    spec = {0: [1], 1: [1, 2, 3], 2: [1, 2], 3: [1, 3], 4: [1, 2, 3, 4], 5: [4], 6: [1, 2, 3, 4], 7: [4], 9: [1, 4], 12: [1]}
    landings = [[0, 1, 2], [3], [4, 5], [6, 7, 9], [12]]
    for part in landings:
        changes = timed.changelog(land(spark, folder, runs({r: spec[r] for r in part}), SEEN), work, 6, "1 hour", 6.0)
    net = timed.net_entries(changes.withColumn("now", F.lit(at(72 + 1))), 6, F.col("now"), 6.0)
    got = {(r.run - base, r.symbol): (r.kind, r.taken_back, r.settled) for r in net.collect()}
    back, kept = ("retest", True, False), ("retest", False, True)
    assert got == {
        (1, 2): ("fresh", False, True), (1, 3): ("fresh", False, True), (3, 3): back, (4, 2): back, (4, 4): ("fresh", False, True),
        (6, 1): back, (6, 2): back, (6, 3): back, (9, 1): kept,
    }
    # Only the last run and its base are kept of all members.
    tail = [p for p in os.listdir(f"{work}/tail")]
    assert len(tail) <= 2 and {r.run - base for r in spark.read.parquet(f"{work}/tail/{max(map(int, tail))}").collect()} == {7, 9}


def test_weeks_close_once_and_late_rows_correct_them(spark, tmp_path):
    schema, folder, work = "ts timestamp, user_id bigint, value double", str(tmp_path / "in"), str(tmp_path / "work")
    day = lambda d, u, v: (at(d * 24 + 12), u, v)
    landings = [[day(0, 1, 5.0), day(6, 2, 1.0), (None, 9, 9.0)], [day(8, 1, 2.0), day(6, 1, 7.0)], [day(16, 3, 1.0), day(13, 1, 4.0)], [day(1, 1, 9.0), day(2, 4, 3.0), day(17, 3, 2.0)]]
    for rows in landings:
        out = timed.weeks_once(land(spark, folder, rows, schema), work, "1 day")
    got = {(r.week.day, r.user_id): (r.high, r.low, r.n) for r in out.collect()}
    assert got == {(1, 1): (9.0, 5.0, 3), (1, 2): (1.0, 1.0, 1), (8, 1): (4.0, 2.0, 2), (1, 4): (3.0, 3.0, 1)}
    # The store holds the open week only.
    state = timed.state_of(spark, f"{work}/weeks-log").select("key.user_id").collect()
    assert [r.user_id for r in state] == [3]
    late = spark.read.parquet(f"{work}/routed").where("__late = 'true'").collect()
    assert sorted(r.value for r in late) == [3.0, 9.0]


def test_resting_orders(spark, tmp_path):
    order, bar = "id long, symbol long, placed_at timestamp, trigger double, deadline date", "symbol long, bar_at timestamp, open double, high double"
    o = lambda i, s, d, t, until: (i, s, at(d * 24 + 18), t, at(until * 24).date())
    b = lambda s, d, op, h: (s, at(d * 24 + 12), op, h)
    orders = [[o(1, 1, 0, 10.0, 3), o(2, 1, 0, 20.0, 3), o(3, 2, 1, 5.0, 2), (4, 2, at(18), None, at(72).date())], [o(5, 1, 30, 9.0, 33)], [o(6, 1, 59, 9.0, 62), o(7, 3, 2, 1.0, 5)]]
    bars = [[b(1, 0, 99.0, 99.0), b(1, 1, 9.0, 10.0), b(1, 2, 11.0, 12.0), b(1, 3, 1.0, 50.0), b(2, 3, 9.0, 9.0)], [b(1, 31, 1.0, 9.5), b(3, 3, 2.0, 3.0)], [b(1, 60, 1.0, 1.0), b(2, 2, 5.5, 6.0)]]
    work = str(tmp_path / "work")
    for k in range(3):
        streams = land(spark, str(tmp_path / "o"), orders[k], order), land(spark, str(tmp_path / "b"), bars[k], bar)
        out = timed.resting_orders(*streams, work, ["id"], "2 days", 7)
        if k == 1:
            assert {r.id: r.status for r in out.collect()} == {1: "filled", 2: "filled", 3: "expired", 4: "expired", 5: "filled"}
    got = {r.id: (r.status, r.fill_at, r.fill) for r in out.collect()}
    # Order 3 fills by a bar that came after the stream had let it go; order 7 came late itself.
    assert got == {
        1: ("filled", at(2 * 24 + 12), 11.0), 2: ("filled", at(3 * 24 + 12), 20.0), 3: ("filled", at(2 * 24 + 12), 5.5), 4: ("expired", None, None),
        5: ("filled", at(31 * 24 + 12), 9.0), 6: ("waiting", None, None), 7: ("filled", at(3 * 24 + 12), 2.0),
    }


def test_resting_orders_meet_bars_of_their_own_weeks_only(spark, tmp_path):
    order, bar = "id long, symbol long, placed_at timestamp, trigger double, deadline date", "symbol long, bar_at timestamp, open double, high double"
    # 6 to 7 days lie between an order and its bar, over and inside the ends of stretches of 7 days; the last bar comes too late.
    orders = [(d, 1, at(d * 24 + 18), 10.0, at((d + 7) * 24).date()) for d in (0, 6, 13, 20)]
    bars = [(1, at(d * 24 + h), 9.0, 11.0) for d, h in ((7, 12), (13, 18), (20, 17), (27, 19))]
    work = str(tmp_path / "work")
    out = timed.resting_orders(land(spark, str(tmp_path / "o"), orders, order), land(spark, str(tmp_path / "b"), bars, bar), work, ["id"], "30 days", 7)
    want = {0: at(7 * 24 + 12), 6: at(7 * 24 + 12), 13: at(20 * 24 + 17), 20: None}
    assert {r.id: r.fill_at for r in out.collect()} == want
    held = spark.read.format("statestore").option("path", f"{work}/resting-log").option("joinSide", "left").load()
    assert held.select("key").distinct().count() > 1


def test_resting_orders_open_one_store_a_task(spark, tmp_path):
    order, bar = "id long, symbol long, placed_at timestamp, trigger double, deadline date", "symbol long, bar_at timestamp, open double, high double"
    work = str(tmp_path / "work")
    orders = land(spark, str(tmp_path / "o"), [(1, 1, at(18), 10.0, at(72).date())], order)
    bars = land(spark, str(tmp_path / "b"), [(1, at(36), 9.0, 11.0)], bar)
    assert [(r.status, r.fill) for r in timed.resting_orders(orders, bars, work, ["id"], "2 days", 7).collect()] == [("filled", 10.0)]
    # Rows and counts of both sides share it; each used to have a store of its own.
    assert not [d for d in os.listdir(f"{work}/resting-log/state/0/0") if d.startswith(("left", "right"))]


def test_once_only_keeps_its_keys_on_disk(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    for values in (["a", "b", "a", None], ["b", "c", None], []):
        out = jobs.once_only(land(spark, folder, [(v,) for v in values], "k string"), work, ["k"])
    assert sorted((r.k or "") for r in out.collect()) == ["", "a", "b", "c"]
    assert timed.state_of(spark, f"{work}/keys-log").count() == 4


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_writes_only_the_buckets_it_meets(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k long, n long, v string"
    rows = lambda *x: spark.createDataFrame(list(x), shape)
    assert tables.read_buckets(spark, path, rows().schema).count() == 0
    tables.merge_buckets(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"), F.lit("a").alias("v")), path, 0, ["k"], ["n"], 8)
    first = files(f"{path}/data")
    assert len(first) == 8
    change = rows((5, 2, "b"), (6, 0, "old"), (5000, 1, "new"))
    met = {r[0] for r in change.select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    for _ in range(2):  # a replayed batch writes the same again
        tables.merge_buckets(change, path, 1, ["k"], ["n"], 8)
        now = tables.read_buckets(spark, path, change.schema)
        assert now.count() == 1001 and {(r.k, r.v) for r in now.where("k IN (5, 6, 5000)").collect()} == {(5, "b"), (6, "a"), (5000, "new")}
        assert len(files(f"{path}/data/version=1")) == len(met) and first <= files(f"{path}/data")
    tables.merge_buckets(rows((5, 3, "c")), path, 2, ["k"], ["n"], 8)
    tables.merge_buckets(rows(), path, 3, ["k"], ["n"], 8)
    # Of versions that neither the newest nor the one before names, nothing is left.
    kept = {f"version={v}/bucket={b}" for b, v in tables.bucket_folders(spark, path).items()}
    assert {os.path.relpath(os.path.dirname(f), f"{path}/data") for f in files(f"{path}/data")} == kept
    assert sorted(os.listdir(f"{path}/manifest")) == ["2", "3"]
    got = tables.read_buckets(spark, path, change.schema)
    assert got.count() == 1001 and got.where("k = 5").first()["v"] == "c"


def test_latest_bars_without_new_files(spark, tmp_path):
    shape, folder, work = "k long, n long, v string", str(tmp_path / "in"), str(tmp_path / "work")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "d")]):
        out = jobs.latest_bars(land(spark, folder, rows, shape), work, ["k"], ["n"])
    again = jobs.latest_bars(spark.readStream.schema(shape).parquet(folder), work, ["k"], ["n"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect())) == [(1, 3, "c"), (2, 1, "b")]

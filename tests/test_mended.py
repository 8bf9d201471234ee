"""Cases that earlier versions got wrong."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.numbers import to_number
from tidemark.operators import bars as bar_ops
from tidemark.operators import membership
from tidemark.plans import summaries
from tidemark.streaming import jobs


def test_numbers_with_long_exponents(spark):
    texts = ["1e100", "1e-120", "1e400", "-2.5E+3", "1" * 200, "nan", "1e", "12,5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_number(F.col("t"))).collect()]
    assert got == [1e100, 1e-120, None, -2500.0, float("1" * 200), None, None, 125.0]


def stamps(*days):
    return [dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=d) for d in days]


def land(spark, folder, rows):
    frame = spark.createDataFrame([(i, t, u, "scan", v, "{}") for i, (t, u, v) in enumerate(rows)], jobs.EVENTS)
    frame.coalesce(1).write.mode("append").parquet(folder)
    return jobs.event_stream(spark, folder, "*.parquet", 1)


def test_once_ever_over_long_gaps_and_late_keys(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    for days in ((0,), (60,), (0, 110), (4, 60)):
        stream = land(spark, folder, [(t, 1, 1.0) for t in stamps(*days)])
        out = jobs.once_only(stream.select(F.to_date("ts").alias("day")), work, ["day"])
    assert sorted(r.day.day for r in out.collect()) == sorted(t.day for t in stamps(0, 60, 110, 4))


def test_late_rows_correct_a_week(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    # User 1's first week is over by a later bar, user 2's by the clock; a row of each comes late.
    for rows in ([(0, 1, 5.0), (1, 2, 4.0)], [(8, 1, 1.0), (38, 3, 1.0)], [(2, 1, 9.0), (3, 2, 2.0)]):
        stream = land(spark, folder, [(stamps(d)[0], u, v) for d, u, v in rows])
        out = jobs.closed_weeks(stream, work)
    got = {(r.user_id, r.week.day): (r.high, r.low, r.n) for r in out.collect()}
    assert got == {(1, 1): (9.0, 5.0, 2), (1, 8): (1.0, 1.0, 1), (2, 1): (4.0, 2.0, 2)}


def test_runs_cut_by_batches(spark, tmp_path):
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")

    def members(rows):
        return rows.select(F.col("event_type").alias("scanner"), F.col("user_id").alias("symbol"), F.dayofyear("ts").cast("long").alias("run"))

    landings = [[(0, 1), (1, 1)], [(1, 2), (2, 1)], [(2, 3), (3, 2)], [(1, 4), (3, 5)]]
    for rows in landings:
        out = jobs.membership_diff(land(spark, folder, [(stamps(d)[0], u, 1.0) for d, u in rows]), members, work)
    whole = spark.createDataFrame([("scan", u, d + 1, d + 1) for rows in landings for d, u in rows], "scanner string, symbol long, run long, run_at long")
    want = membership.entries(whole).select("scanner", "symbol", "run", "prev_run", "kind")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() == 5


def test_half_read_runs_of_any_age(spark):
    rows = []
    for run in range(100):
        for symbol in range(4):
            if run == 3 and symbol > 1:
                continue
            rows.append(("s", symbol, run, dt.datetime(2024, 1, 1) + dt.timedelta(hours=run)))
    found = membership.partial_reads(spark.createDataFrame(rows, "scanner string, symbol long, run long, run_at timestamp"), 2.0)
    assert [tuple(r) for r in found.collect()] == [("s", 3, 2, 4)]


def test_the_forming_bar_of_a_past_moment(spark):
    rows = [(1, dt.date(2024, 1, d), 1.0) for d in (2, 3, 4, 5)]
    bars = spark.createDataFrame(rows, "symbol long, date date, close double").where("date <= '2024-01-04'")
    done = bar_ops.completed(bar_ops.numbered(bars), F.lit("2024-01-04 06:00:00").cast("timestamp"), "15:30")
    assert sorted(r.date.day for r in done.collect()) == [2, 3]


def test_blank_and_null_groups_are_one(spark):
    rows = [("s", "1m", 1.0, 0.5, None if i % 2 else "", "", dt.date(2024, 1, 1)) for i in range(24)]
    holds = spark.createDataFrame(rows, "scanner string, horizon string, ret double, index_ret double, tier string, sector string, entry_date date")
    tiers = [r for r in summaries.group_cells(holds, min_n=20).collect() if r.dimension == "tier"]
    assert [(r.grp, r.n, r.up) for r in tiers] == [("Unknown", 24, 1.0)]

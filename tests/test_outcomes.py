"""Golden examples and brute-force checks of bars, indicators, touches and exits."""

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.config import Rule
from tidemark.functions.rules import RuleBook
from tidemark.operators import asof, bars, indicators, outcomes, signals, smoothing

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"
HIT = "scanner string, symbol string, hit_date date, tier string, sector string"
RULES = RuleBook({"W": Rule(weekly=True, window=5), "D": Rule(), "S": Rule(max_hold=4)})


def days(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def frame(spark, rows):
    return bars.numbered(spark.createDataFrame(rows, BAR))


def test_weekly_signal_bar_is_known_at_week_end(spark):
    highs = [101.0, 103.0, 108.0, 110.0, 111.0, 112.0]
    rows = [("A", d, h - 1, h, 99.0 + i, h - 1, 1.0) for i, (d, h) in enumerate(zip(days(6), highs))]
    hit = spark.createDataFrame([("W", "A", days(1)[0], "", "")], HIT)
    got = signals.locate(hit, frame(spark, rows), RULES).first()
    assert (got.trigger, got.bar_low, got.bar_close, got.signal_date) == (111.0, 99.0, 110.0, days(5)[4])
    open_week = signals.locate(hit, frame(spark, rows[:3]), RULES).first()
    assert open_week.end_pos is None


def test_touch_gap_fill_waiting_and_no_breakout(spark):
    d = days(6)
    rows = [("A", d[0], 99.0, 100.0, 98.0, 99.0, 1.0), ("A", d[1], 103.0, 104.0, 102.0, 103.0, 1.0)]
    rows += [("B", d[0], 99.0, 100.0, 98.0, 99.0, 1.0), ("B", d[1], 99.0, 100.0, 98.0, 99.0, 1.0)]
    rows += [("C", x, 99.0, 100.0, 98.0, 99.0, 1.0) for x in d]
    hits = spark.createDataFrame([("D", s, d[0], "", "") for s in "ABC"], HIT)
    got = {r.symbol: r for r in outcomes.first_touch(signals.locate(hits, frame(spark, rows), RULES), RULES).collect()}
    assert (got["A"].entry, got["A"].gap, got["A"].status) == (103.0, True, "touched")
    assert (got["B"].status, got["B"].sessions_left) == ("waiting", 2)
    assert got["C"].status == "no breakout"


def brute_exit(o, l, c, ema, e, entry, stop_pct, hold):
    """Plain bar loop: (status, price)."""
    stop, n = entry * (1 - stop_pct / 100), len(c)
    for i in range(e, min(n - 1, e + hold) + 1):
        if i > e and o[i] <= stop:
            return "stop", o[i]
        if l[i] <= stop:
            return "stop", stop
        if i > e and not np.isnan(ema[i]) and c[i] < ema[i]:
            return ("average", o[i + 1]) if i + 1 < n else ("holding", c[i])
    if e + hold <= n - 1:
        return "time", c[e + hold]
    return "holding", c[-1]


def test_exits_match_a_bar_loop(spark):
    rng = random.Random(7)
    rows, paths = [], {}
    for s in range(12):
        px, d = 100.0, days(140)
        series = []
        for x in d:
            o = px * (1 + rng.uniform(-0.06, 0.06))
            c = o * (1 + rng.uniform(-0.06, 0.065))
            h, l = max(o, c) * (1 + rng.uniform(0, 0.02)), min(o, c) * (1 - rng.uniform(0, 0.02))
            px = c
            series.append((o, h, l, c))
            rows.append((f"S{s}", x, o, h, l, c, 1.0))
        paths[f"S{s}"] = (d, series)
    hits = [("D" if k % 2 else "S", s, paths[s][0][k], "", "") for s in paths for k in range(0, 138, 3)]
    table = frame(spark, rows)
    at = outcomes.first_touch(signals.locate(spark.createDataFrame(hits, HIT), table, RULES), RULES)
    got = {(r.scanner, r.symbol, r.hit_date): r for r in outcomes.barrier_exit(at, table, RULES).collect()}
    seen = set()
    for scanner, s, day, _, _ in hits:
        d, series = paths[s]
        o, h, l, c = (np.array(x) for x in zip(*series))
        ema = pd.Series(c).ewm(span=30, adjust=False, min_periods=30).mean().to_numpy()
        k = d.index(day)
        e = next((i for i in range(k + 1, min(k + 4, len(d))) if h[i] > h[k]), None)
        if e is None:
            assert (scanner, s, day) not in got
            continue
        status, price = brute_exit(o, l, c, ema, e, max(o[e], h[k]), 15.0, 4 if scanner == "S" else 250)
        row = got[(scanner, s, day)]
        assert row.status == status
        assert abs((row.exit if row.exit is not None else row.now) - price) < 1e-9
        assert row.ret == round((price / max(o[e], h[k]) - 1) * 100 - 0.25, 2)
        seen.add(status)
    assert seen == {"stop", "average", "time", "holding"}


def test_smoothing_equals_pandas_and_keeps_constants(spark):
    rng = np.random.default_rng(3)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 2500)))
    rows = [("A", i, float(v)) for i, v in enumerate(x)] + [("B", i, 101.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "symbol string, pos int, close double")
    out = smoothing.exp_smooth(df, {"close": "y"}, 2 / 31, ["symbol"]).orderBy("symbol", "pos").collect()
    want = pd.Series(x).ewm(span=30, adjust=False).mean().to_numpy()
    got = np.array([r.y for r in out if r.symbol == "A"])
    assert np.max(np.abs(got / want - 1)) < 1e-12
    assert all(r.y == 101.0 for r in out if r.symbol == "B")


def test_rsi_equals_pandas(spark):
    rng = np.random.default_rng(5)
    c = pd.Series(100 + np.cumsum(rng.normal(0, 1, 700)))
    d = days(700)
    rows = [("A", d[i], v, v, v, v, 1.0) for i, v in enumerate(map(float, c))]
    got = [r.rsi14 for r in indicators.rsi(frame(spark, rows)).orderBy("pos").collect()]
    move = c.diff()
    gain = move.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-move.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    want = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(100)
    assert np.max(np.abs(np.array(got) - want.to_numpy())) < 1e-8


def test_indicators_do_not_look_ahead(spark):
    rng = np.random.default_rng(9)
    c = 100 + np.cumsum(rng.normal(0, 1, 320))
    d = days(320)
    rows = [("A", d[i], float(v), float(v) + 1, float(v) - 1, float(v), float(1000 + i % 7)) for i, v in enumerate(c)]
    names = ["ret_60d", "dist_sma200", "rsi14", "atr_pct", "vol_ratio", "dist_52w_high", "log_turnover", "up_days_10"]
    full = indicators.all_indicators(frame(spark, rows)).where("pos = 250").select(*names).first()
    cut = indicators.all_indicators(frame(spark, rows[:251])).where("pos = 250").select(*names).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(full, cut))


def test_zero_volume_gives_no_infinity(spark):
    d = days(60)
    rows = [("A", x, 10.0, 11.0, 9.0, 10.0, 0.0 if i < 59 else 500.0) for i, x in enumerate(d)]
    out = indicators.volume(frame(spark, rows)).where("pos = 59").first()
    assert out.vol_ratio is None and out.log_turnover is not None


def test_snap_takes_the_session_before_only_with_later_bars(spark):
    d = days(3, "2024-01-03")  # Wed, Thu, Fri
    rows = [("A", x, 1.0, 1.0, 1.0, 1.0, 1.0) for x in d] + [("A", dt.date(2024, 1, 8), 1.0, 1.0, 1.0, 1.0, 1.0)]
    hits = spark.createDataFrame(
        [("D", "A", dt.date(2024, 1, 6)), ("D", "A", dt.date(2024, 1, 9))], "scanner string, symbol string, hit_date date"
    )
    got = {r.hit_date: r.session_date for r in asof.snap_to_session(hits, frame(spark, rows)).collect()}
    assert got == {dt.date(2024, 1, 6): dt.date(2024, 1, 5), dt.date(2024, 1, 9): dt.date(2024, 1, 9)}


def test_waiting_order_marks_later_signals_only(spark):
    rows = [("S", "A", dt.date(2024, 1, k), s) for k, s in ((1, "waiting"), (2, "no breakout"), (3, "waiting"))]
    df = spark.createDataFrame(rows, "scanner string, symbol string, hit_date date, status string")
    got = [r.duplicate for r in signals.mark_duplicates(df).orderBy("hit_date").collect()]
    assert got == [False, True, True]


def test_confirmations_cover_ten_days_inclusive(spark):
    rows = [("A", "X", dt.date(2024, 1, 1)), ("B", "X", dt.date(2024, 1, 11)), ("C", "X", dt.date(2024, 1, 12)), ("B", "Y", dt.date(2024, 1, 12))]
    df = spark.createDataFrame(rows, "scanner string, symbol string, hit_date date")
    got = {(r.scanner, r.symbol): r.confirmed_by for r in signals.confirmations(df).collect()}
    assert got == {("A", "X"): [], ("B", "X"): ["A"], ("C", "X"): ["B"], ("B", "Y"): []}


def test_filter_passes_unknown(spark):
    book = RuleBook({"N": Rule(near_high=10.0), "V": Rule(atr_max=4.0)})
    rows = [("N", -11.0, None), ("N", None, 9.0), ("V", -50.0, 4.0), ("V", None, None), ("X", -99.0, 99.0)]
    df = spark.createDataFrame(rows, "scanner string, d double, a double")
    got = [r[0] for r in df.select(book.passes(F.col("scanner"), F.col("d"), F.col("a"))).collect()]
    assert got == [False, True, False, True, True]

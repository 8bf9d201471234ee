"""Day order and value curves against small hand-made tables."""

import datetime as dt

from tidemark.operators import books

SCHEMA = (
    "scanner string, symbol string, hit_date date, tier string, score double, entry_date date, exit_date date, ret double"
)


def day(text):
    return dt.date.fromisoformat(text)


def trade(symbol, start, end, ret, scanner="D", tier="Largecap", score=None):
    return (scanner, symbol, day(start), tier, score, day(start), day(end), ret)


def test_curve_spreads_the_capital(spark):
    # The second exit is a Saturday and counts on Monday.
    rows = [trade("A", "2024-01-01", "2024-01-03", 8.0), trade("B", "2024-01-02", "2024-01-06", -12.0), trade("C", "2024-01-02", "2024-01-05", 1.0, "E")]
    curve = books.spread_curve(spark.createDataFrame(rows, SCHEMA), ["scanner"], 200_000.0)
    got = {(r.scanner, r.date.isoformat()): round(r.value, 6) for r in curve.collect()}
    assert got == {
        ("D", "2024-01-01"): 200_000, ("D", "2024-01-02"): 200_000, ("D", "2024-01-03"): 208_000, ("D", "2024-01-04"): 208_000,
        ("D", "2024-01-05"): 208_000, ("D", "2024-01-08"): 196_000, ("E", "2024-01-02"): 200_000, ("E", "2024-01-03"): 200_000,
        ("E", "2024-01-04"): 200_000, ("E", "2024-01-05"): 202_000,
    }
    assert books.spread_curve(spark.createDataFrame([], SCHEMA), ["scanner"]).count() == 0


def test_mid_caps_first_and_score_first(spark):
    a = trade("S1", "2024-01-01", "2024-01-10", 8.0, tier="Smallcap", score=0.7)
    b = trade("M1", "2024-01-01", "2024-01-10", 8.0, tier="Midcap", score=0.4)
    again = trade("S1", "2024-01-01", "2024-01-10", 8.0, "E", tier="Smallcap", score=0.7)
    df = spark.createDataFrame([a, b, again], SCHEMA)
    assert {r.book: (r.symbol, r.place) for r in books.day_first(df, slots=1).collect()} == {"tier": ("M1", 1), "score": ("S1", 1)}
    assert books.day_first(df).groupBy("book").count().collect()[0][1] == 2


def test_growth_and_fall(spark):
    rows = [("D", day("2024-01-01"), 100.0), ("D", day("2024-07-01"), 150.0), ("D", day("2025-01-01"), 120.0)]
    row = books.growth_stats(spark.createDataFrame(rows, "scanner string, date date, value double"), ["scanner"]).first()
    assert (row["first"], row["last"], round(row["max_fall"], 6)) == (100.0, 120.0, -20.0) and 19 < row["cagr"] < 21

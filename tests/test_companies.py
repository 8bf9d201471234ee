"""Screen, score, overlay, exports, pages, announcements, pulse, quality and scalar functions."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import dates, numbers, rules, text
from tidemark.plans import fundamentals as fund
from tidemark.plans import pulse, quality
from tidemark.sources import files, pages, scans

GOOD = {
    "Name": "Demo", "NSE Code": "DEMO", "Industry": "Tools", "Current Price": "95", "High price": "100",
    "Market Capitalization": "1,200", "Return on capital employed": "22", "OPM": "12", "Debt to equity": "0.2",
    "Pledged percentage": "0", "Promoter holding": "61", "Profit growth": "45", "Debtor days": "60", "Price to Earning": "15",
}


def company(spark, **changes):
    row = GOOD | changes
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    return fund.fields(df).withColumn("code", F.col("nse"))


def test_screen_all_met_one_unknown_and_too_few(spark):
    full = fund.screened(company(spark)).first()
    assert (full.passed, full.checked, full.ok) == (10, 10, True)
    blank = fund.screened(company(spark, **{"Pledged percentage": ""})).first()
    assert (blank.checked, blank.unknown, blank.ok) == (9, ["Pledge"], True)
    bare = {k: "" for k in GOOD if k not in ("Name", "NSE Code", "Promoter holding", "OPM")}
    few = fund.screened(company(spark, **bare)).first()
    assert (few.checked, few.fail_labels, few.ok) == (2, [], False)
    nan = fund.screened(company(spark, **{"OPM": "nan"})).first()
    assert nan.unknown == ["OPM"]


def test_score_without_data_and_loss_maker(spark):
    empty = fund.scored(company(spark, **{k: "" for k in GOOD if k not in ("Name", "NSE Code")})).first()
    assert empty.score is None and empty.verdict == "" and empty.coverage == 0
    loss = fund.scored(company(spark, **{"Price to Earning": "-4"})).first()
    assert loss.s_valuation == 0
    low = fund.scored(company(spark, **{"Promoter holding": "20"})).first()
    assert low.verdict.startswith("Reject: low promoter")


def test_bank_is_checked_on_roe(spark):
    row = company(spark, **{"Industry": "Private Bank", "Return on capital employed": "3", "Return on equity": "9"})
    out = fund.checked(row.withColumn("origin", F.lit("export"))).first()
    assert out.fail_labels == ["ROE"] and out.bank and not out.private


def test_export_newest_file_and_codes(spark, tmp_path):
    (tmp_path / "2026-01-01_1.csv").write_text("﻿Name,NSE Code,BSE Code\nOld,OLD,1\n", encoding="utf-8")
    (tmp_path / "2026-02-01_1.csv").write_text("﻿Name,NSE Code,BSE Code\nNew, new ,5\nLast,NEW,\n", encoding="utf-8")
    rows = files.newest_file_rows(spark, str(tmp_path))
    got = {r.code: (r.Name, r["__asof"]) for r in files.rows_by_code(rows, ["NSE Code", "BSE Code"], ["__row"]).collect()}
    day = dt.date(2026, 2, 1)
    assert got == {"NEW": ("Last", day), "5": ("New", day)}


def test_hit_exports(spark, tmp_path):
    (tmp_path / "My_scan.csv").write_text('﻿"Date","Symbol","Sector"\n"28-08-2017"," abc ","Plastic"\n', encoding="utf-8")
    row = files.hit_exports(spark, str(tmp_path)).first()
    assert (row.scanner, row.symbol, row.hit_date, row.tier, row.sector) == ("My_scan", "ABC", dt.date(2017, 8, 28), "", "Plastic")


def test_calendar_and_model_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"scrip_Code":"1 ","short_name":"ab","Long_Name":"AB","meeting_date":"12 Nov 2026"},{"scrip_Code":"2","meeting_date":"soon"}]')
    rows = files.event_calendar(spark, str(tmp_path / "c.json")).collect()
    assert [(r.code, r.short_name, r.meeting_date) for r in rows] == [("1", "AB", dt.date(2026, 11, 12))]
    assert files.model_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert files.model_file(spark, str(tmp_path / "bad.json")).count() == 0


def page():
    def table(rows, heads):
        head = "".join(f"<th> {h} </th>" for h in heads)
        body = "".join(f"<tr><td class='x'>{label}</td>" + "".join(f"<td> {v} </td>" for v in vals) + "</tr>" for label, vals in rows)
        return f'<table class="data-table"><thead><tr><th></th>{head}</tr></thead><tbody>{body}</tbody></table>'

    years = ["Mar 2025", "Mar 2026", "TTM"]
    return (
        "<html><h1>Sample Works Ltd</h1><ul id=\"top-ratios\"><li><span class=\"name\"> Market Cap </span>"
        "<span class=\"value\">₹ <span class=\"number\">2,500</span> Cr.</span></li><li><span class=\"name\">High / Low</span>"
        "<span class=\"number\">80</span> / <span class=\"number\">40</span></li></ul>"
        "<section id=\"quarters\">" + table([("Net Profit&nbsp;+", [10, 11, 12, 13, 30])], ["a", "b", "c", "d", "e"]) + "</section>"
        "<section id=\"profit-loss\">" + table([("Sales&nbsp;<span>+</span>", [100, 130, 140]), ("OPM %", ["10%", "12%", "13%"]), ("Net Profit", [20, 25, 26])], years)
        + '<table class="ranges-table"><tr><th>Compounded Sales Growth</th></tr><tr><td>5 Years:</td><td>9%</td></tr><tr><td>3 Years:</td><td>17%</td></tr></table></section>'
        "<section id=\"balance-sheet\">" + table([("Equity Capital", [10, 10]), ("Reserves", [100, 190]), ("Borrowings", [40, 50])], years[:2]) + "</section>"
        "<section id=\"ratios\">" + table([("Debtor Days", [60, 75]), ("ROCE %", ["18%", "21%"])], years[:2]) + "</section></html>"
    )


def test_company_page(spark):
    row = pages.company_rows(spark.createDataFrame([(1, "u", page())], "page_id int, url string, html string")).first()
    assert (row.name, row.mcap, row.high, row.opm) == ("Sample Works Ltd", 2500.0, 80.0, 12.0)
    assert (row.sales1y, row.profit1y, row.profit_q) == (30.0, 25.0, 200.0)
    assert (row.de, row.debt, row.debt_change) == (0.25, 50.0, 10.0)
    assert (row.debtor_days, row.debtor_days_ch, row.roce, row.sales3y, row.profit3y) == (75.0, 15.0, 21.0, 17.0, None)


def test_board_meetings(spark):
    told = [
        "Board Meeting on 12 November 2026 for quarterly results", "Intimation dated 01-11-2026: board  meeting on Dec 15, 2026",
        "Board meet 13/11/2026, financial Results", "Board meeting soon", "Dividend paid 1 Nov 2026",
    ]
    got = pages.board_meetings(spark.createDataFrame([(t,) for t in told], "text string")).collect()
    assert [(r.day.isoformat(), r.what) for r in got] == [("2026-11-12", "results"), ("2026-12-15", "board meeting"), ("2026-11-13", "results")]


def test_titles_are_trusted_only_when_unique(spark):
    rows = [(1, "A"), (1, "x"), (2, "A"), (2, "A"), (3, "x")]
    df = spark.createDataFrame(rows, "snapshot int, title string")
    got = {r.snapshot: r.trusted for r in scans.trusted_titles(df, ["A", "B"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_dates(spark):
    import numpy as np
    import pandas as pd

    starts = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(21)]
    df = spark.createDataFrame([(a, a + dt.timedelta(days=k)) for a in starts for k in range(0, 17, 4)], "a date, b date")
    out = df.select("a", "b", dates.workdays_held(F.col("a"), F.col("b")).alias("n"), dates.add_workdays(F.col("a"), 7).alias("z")).collect()
    for r in out:
        assert r.n == int(np.busday_count(r.a, r.b)) + 1
        assert r.z == (pd.Timestamp(r.a) + pd.offsets.BDay(7)).date()
    times = ["2026-11-09 03:40:00", "2026-11-09 03:50:00", "2026-11-09 04:30:00", "2026-11-07 05:00:00", "2026-11-09 14:29:00"]
    t = spark.createDataFrame([(x,) for x in times], "s string").withColumn("t", F.col("s").cast("timestamp"))
    got = t.select(dates.session_date(F.col("t")).cast("string"), dates.slot_of(dates.local_time(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [
        ("2026-11-08", None), ("2026-11-09", None), ("2026-11-09", "2026-11-09 10:00"), ("2026-11-07", None), ("2026-11-09", "2026-11-09 15:00"),
    ]


def test_numbers_and_names(spark):
    vals = ["1,234.5%", " 7 ", "x", "nan", "1d", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(numbers.to_number(F.col("v"))).collect()] == [1234.5, 7.0, None, None, None, None, None]
    sym = spark.createDataFrame([("^IDX",), ("500001",), ("ABC",)], "s string")
    assert [r[0] for r in sym.select(text.vendor_ticker(F.col("s"))).collect()] == ["^IDX", "500001.BO", "ABC.NS"]
    halves = [0.125, 2.675, -1.005, 6.35, 1e6 + 0.005, -0.001]
    out = spark.createDataFrame([(h,) for h in halves], "v double").select(numbers.round_binary(F.col("v"), 2)).collect()
    assert [r[0] for r in out] == [round(h, 2) for h in halves]
    tiers = spark.createDataFrame([(None,), (200.0,), (30_000.0,), (100_000.0,)], "m double").select(rules.tier_from_size(F.col("m"))).collect()
    assert [r[0] for r in tiers] == [None, "Smallcap", "Midcap", "Largecap"]


def test_pulse_of_a_rising_index(spark):
    rows = [("i", dt.date(2025, 1, 1) + dt.timedelta(days=k), 100.0 + k) for k in range(260)]
    got = pulse.index_pulse(spark.createDataFrame(rows, "name string, date date, close double")).first()
    assert got.trend == "Uptrend" and got.close == 359.0 and got.vs200 > got.vs50 > 0


def test_price_outside_the_day_is_named(spark):
    bars = spark.createDataFrame([("A", dt.date(2026, 1, 5), 99.0, 105.0), ("A", dt.date(2026, 1, 6), 100.0, 110.0)], "symbol string, date date, low double, high double")
    schema = "scanner string, symbol string, hit_date date, status string, entry_date date, entry double, exit_date date, exit double, ret double, last_close double"
    good = ("D", "A", dt.date(2026, 1, 2), "holding", dt.date(2026, 1, 5), 100.0, None, None, round((108 / 100 - 1) * 100 - 0.25, 2), 108.0)
    bad = ("E", "A", dt.date(2026, 1, 2), "average", dt.date(2026, 1, 5), 120.0, dt.date(2026, 1, 6), 101.0, -1.0, 108.0)
    got = quality.price_mismatches(spark.createDataFrame([good, bad], schema), bars).collect()
    assert [(r.scanner, r.fault) for r in got] == [("E", "buy")]


def test_fixed_rules():
    assert config.LIVE_RULES["Wkly_upswing"].weekly and config.LIVE_RULES["63_30_daily"].near_high == 10.0


def test_exports_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "A+B.csv").write_text("Symbol,Date,Marketcapname\nabc,03-04-2021,Midcap\n")
    (tmp_path / "Z.csv").write_text('﻿Sector,Date,Symbol,More\n"Oil, gas",04-04-2021,xyz,1\n', encoding="utf-8")
    got = {r.scanner: (r.symbol, str(r.hit_date), r.tier, r.sector) for r in files.hit_exports(spark, str(tmp_path)).collect()}
    assert got == {"A+B": ("ABC", "2021-04-03", "Midcap", ""), "Z": ("XYZ", "2021-04-04", "", "Oil, gas")}
    newest = files.newest_file_rows(spark, str(tmp_path)).collect()
    assert [(r.Sector, r.Symbol) for r in newest] == [("Oil, gas", "xyz")]


def test_announced_dates(spark):
    texts = ["on 12th of November, 2026, then Dec 3, 2025 or 01-02-2024", "31/02/2024, 4 April 1999", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[str(d) for d in r.d] if r.d is not None else None for r in df.select(pages.announced_dates(F.col("t")).alias("d")).collect()]
    assert got == [["2026-11-12", "2025-12-03", "2024-02-01"], [], [], None]

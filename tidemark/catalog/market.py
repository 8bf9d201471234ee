"""Bars, indicators, index state and breadth."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import asof, indicators
from ..operators import bars as bar_ops
from ..plans import pulse as pulse_plan
from ..sources import standin
from .base import query, with_views


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("daily_bars", "S5", with_views("bars", """
SELECT symbol, date, pos, n_bars, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low,
       round(close, 4) AS close, volume FROM bars"""))
def daily_bars(spark, sf):
    return rounded(bar_ops.clean(standin.bars(spark, sf)), 4, "open", "high", "low", "close")


@query("bars_since", "S5 A18", with_views("bars", """
SELECT symbol, date, round(close, 4) AS close FROM bars
WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 400 DAY"""))
def bars_since(spark, sf):
    bars = standin.bar_table(spark, sf)
    # One day, known before the bars are read, so that the bound reaches their scan.
    newest = standin.table(spark, sf, "lineitem").agg(F.date_sub(F.to_date(F.max("l_shipdate")), 400).alias("start")).first()
    return rounded(bar_ops.since(bars, F.lit(newest["start"]), ["close"]), 4, "close")


@query("weekly_bars", "A14 D3", with_views("weeks", """
SELECT symbol, week, start_pos, end_pos, end_date, round(high, 4) AS high, round(low, 4) AS low,
       round(close, 4) AS close, end_pos < n_bars - 1 OR isodow(end_date) >= 5 AS closed FROM weeks"""))
def weekly_bars(spark, sf):
    weeks = bar_ops.weekly(standin.bars(spark, sf)).withColumn("closed", bar_ops.week_closed())
    return rounded(weeks.drop("n_bars"), 4, "high", "low", "close")


@query("completed_bars", "F4 T6", with_views("bars", """
SELECT symbol, count(*) AS bars, max(date) AS last_day FROM bars WHERE date < DATE '2001-10-15' GROUP BY symbol"""))
def completed_bars(spark, sf):
    # 06:00 UTC is 11:30 local, so that day's bar is still forming and the day before is the last complete one.
    day = standin.bar_table(spark, sf).where(F.col("date") <= F.lit("2001-10-15").cast("date"))
    seen = bar_ops.numbered(day.drop("pos", "n_bars"))
    done = bar_ops.completed(seen, F.lit("2001-10-15 06:00:00").cast("timestamp"), "15:30")
    return done.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("last_day"))


@query("ind_returns", "W1", with_views("bars", """
SELECT symbol, pos, round((close / lag(close, 1) OVER w - 1) * 100, 6) AS ret_1d,
       round((close / lag(close, 5) OVER w - 1) * 100, 6) AS ret_5d,
       round((close / lag(close, 20) OVER w - 1) * 100, 6) AS ret_20d,
       round((close / lag(close, 60) OVER w - 1) * 100, 6) AS ret_60d
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)"""))
def ind_returns(spark, sf):
    out = indicators.returns(standin.bar_table(spark, sf))
    names = ["ret_1d", "ret_5d", "ret_20d", "ret_60d"]
    return rounded(out, 6, *names).select("symbol", "pos", *names)


@query("ind_sma", "W2", with_views("bars", """
SELECT symbol, pos,
       CASE WHEN pos >= 15 THEN round((close / avg(close) OVER (w ROWS 19 PRECEDING) - 1) * 100, 6) END AS dist_sma20,
       CASE WHEN pos >= 39 THEN round((close / avg(close) OVER (w ROWS 49 PRECEDING) - 1) * 100, 6) END AS dist_sma50,
       CASE WHEN pos >= 159 THEN round((close / avg(close) OVER (w ROWS 199 PRECEDING) - 1) * 100, 6) END AS dist_sma200
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)"""))
def ind_sma(spark, sf):
    names = ["dist_sma20", "dist_sma50", "dist_sma200"]
    return rounded(indicators.average_distance(standin.bar_table(spark, sf)), 6, *names).select("symbol", "pos", *names)


@query("ind_atr", "W4", with_views("bars", """
SELECT symbol, pos, CASE WHEN pos >= 13 THEN round(avg(tr) OVER (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING) / close * 100, 6) END AS atr_pct
FROM (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""))
def ind_atr(spark, sf):
    return rounded(indicators.atr(standin.bar_table(spark, sf)), 6, "atr_pct").select("symbol", "pos", "atr_pct")


@query("ind_volume", "W5 W7 W21", with_views("bars", """
SELECT symbol, pos,
       CASE WHEN pos >= 20 THEN round(volume / avg(volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) END AS vol_ratio,
       CASE WHEN pos >= 19 THEN round(log10(greatest(1.0, avg(close * volume) OVER (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING))), 6) END AS log_turnover,
       true AS volume_known
FROM bars"""))
def ind_volume(spark, sf):
    out = indicators.volume(standin.bar_table(spark, sf))
    return rounded(out, 6, "vol_ratio", "log_turnover").select("symbol", "pos", "vol_ratio", "log_turnover", "volume_known")


@query("ind_high52", "W6", with_views("bars", """
SELECT symbol, pos, CASE WHEN pos >= 119 THEN round((close / max(high) OVER (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING) - 1) * 100, 6) END AS dist_52w_high
FROM bars"""))
def ind_high52(spark, sf):
    out = indicators.high_distance(standin.bar_table(spark, sf))
    return rounded(out, 6, "dist_52w_high").select("symbol", "pos", "dist_52w_high")


@query("ind_updays", "W8", with_views("bars", """
SELECT symbol, pos, CASE WHEN pos >= 9 THEN CAST(sum(up) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) AS INTEGER) END AS up_days_10
FROM (SELECT symbol, pos, CASE WHEN close > lag(close) OVER (PARTITION BY symbol ORDER BY pos) THEN 1 ELSE 0 END AS up FROM bars)"""))
def ind_updays(spark, sf):
    return indicators.up_days(standin.bar_table(spark, sf)).select("symbol", "pos", "up_days_10")


@query("ema30", "W9 X2", with_views("bars lined", "SELECT symbol, pos, round(ema, 6) AS ema FROM lined"))
def ema30(spark, sf):
    return rounded(indicators.exit_line(standin.bar_table(spark, sf)), 6, "ema").select("symbol", "pos", "ema")


@query("rsi14", "W3 X2", with_views("moves steps14", """
SELECT symbol, pos, round(CASE WHEN pos = 0 OR l <= 1e-12 * close THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi14
FROM (SELECT m.symbol, m.pos, m.close, s.g, s.l FROM moves m LEFT JOIN steps14 s ON s.symbol = m.symbol AND s.pos = m.pos)""", {
    "moves": (["bars"], """
        SELECT symbol, pos, close, greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)"""),
    "steps14": (["moves"], """
        SELECT symbol, pos, gain AS g, loss AS l FROM moves WHERE pos = 1
        UNION ALL
        SELECT m.symbol, m.pos, s.g * (1 - 1.0::DOUBLE / 14) + m.gain * (1.0::DOUBLE / 14),
               s.l * (1 - 1.0::DOUBLE / 14) + m.loss * (1.0::DOUBLE / 14)
        FROM steps14 s JOIN moves m ON m.symbol = s.symbol AND m.pos = s.pos + 1"""),
}))
def rsi14(spark, sf):
    return rounded(indicators.rsi(standin.bar_table(spark, sf)), 6, "rsi14").select("symbol", "pos", "rsi14")


@query("market_state", "J7 J8 J6", with_views("index_bars", """
SELECT d.date, a.close AS close, b.close AS close_before,
       round(a.r20, 6) AS index_ret_20d, round(a.d50, 6) AS index_dist_sma50
FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM index_bars) d
ASOF LEFT JOIN (
    SELECT date, close,
           CASE WHEN row_number() OVER w >= 50 THEN (close / lag(close, 20) OVER w - 1) * 100 END AS r20,
           CASE WHEN row_number() OVER w >= 50 THEN (close / avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) - 1) * 100 END AS d50
    FROM index_bars WINDOW w AS (ORDER BY date)) a ON a.date <= d.date
ASOF LEFT JOIN index_bars b ON b.date < d.date"""))
def market_state(spark, sf):
    index = asof.index_features(standin.index_bars(standin.bar_table(spark, sf)))
    filled = asof.filled_calendar(index, ["close", "index_ret_20d", "index_dist_sma50"])
    names = ["index_ret_20d", "index_dist_sma50"]
    return rounded(filled, 6, *names).select("date", "close", "close_before", *names)


@query("pulse", "W18 F20 F21", with_views("marks", """
SELECT 'index' AS name, date, round(close, 1) AS close, round((close / c1 - 1) * 100, 2) AS day,
       CASE WHEN n > 22 THEN round((close / c21 - 1) * 100, 1) END AS month,
       CASE WHEN n >= 50 THEN round((close / a50 - 1) * 100, 1) END AS vs50,
       CASE WHEN n >= 200 THEN round((close / a200 - 1) * 100, 1) END AS vs200,
       CASE WHEN n >= 200 THEN CASE WHEN round((close / a50 - 1) * 100, 1) > 0 AND round((close / a200 - 1) * 100, 1) > 0 THEN 'Uptrend'
                                    WHEN round((close / a200 - 1) * 100, 1) > 0 THEN 'Pullback in an uptrend'
                                    WHEN round((close / a50 - 1) * 100, 1) > 0 THEN 'Recovering' ELSE 'Downtrend' END
            WHEN n >= 50 THEN CASE WHEN round((close / a50 - 1) * 100, 1) > 0 THEN 'Above 50-day average' ELSE 'Below 50-day average' END END AS trend
FROM marks WHERE date = (SELECT max(date) FROM marks)""", {
    "marks": (["index_bars"], """
        SELECT date, close, lag(close, 1) OVER w AS c1, lag(close, 21) OVER w AS c21, row_number() OVER w AS n,
               avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) AS a50, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS a200
        FROM index_bars WINDOW w AS (ORDER BY date)"""),
}))
def pulse(spark, sf):
    index = standin.index_bars(standin.bar_table(spark, sf)).withColumn("name", F.lit("index"))
    return pulse_plan.index_pulse(index)


@query("fear_bands", "F21", with_views("index_bars", """
SELECT date, level, CASE WHEN level < 13 THEN 'calm' WHEN level < 18 THEN 'normal' WHEN level < 25 THEN 'nervous' ELSE 'fearful' END AS mood
FROM (SELECT date, abs(close - lag(close) OVER (ORDER BY date)) AS level FROM index_bars) WHERE level IS NOT NULL"""))
def fear_bands(spark, sf):
    index = standin.index_bars(standin.bar_table(spark, sf))
    swing = F.abs(F.col("close") - F.lag("close").over(W.orderBy("date")))
    levels = index.select("date", swing.alias("level")).where(F.col("level").isNotNull())
    return levels.withColumn("mood", pulse_plan.mood(F.col("level")))


@query("breadth_listed", "F23 A17", with_views("bars", """
SELECT count(*) FILTER (WHERE close > a50) AS above, count(*) AS total,
       CAST(round(100.0 * count(*) FILTER (WHERE close > a50) / count(*)) AS BIGINT) AS pct
FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING) AS a50, count(*) OVER (PARTITION BY symbol) AS n FROM
        (SELECT * FROM bars WHERE symbol % 4 <> 0 AND date >= (SELECT max(date) FROM bars WHERE symbol % 4 <> 0) - INTERVAL 710 DAY))
WHERE pos = n_bars - 1 AND n >= 50 AND date >= (SELECT max(date) FROM bars) - INTERVAL 30 DAY"""))
def breadth_listed(spark, sf):
    """Breadth beside indexes: every fourth symbol is an index, named with a leading caret."""
    named = F.concat(F.when(F.col("symbol") % 4 == 0, "^").otherwise(""), F.col("symbol").cast("string"))
    return pulse_plan.breadth(standin.bar_table(spark, sf).withColumn("symbol", named), fresh_days=30, history_days=710)


@query("breadth", "A17 D7", with_views("bars", """
SELECT count(*) FILTER (WHERE close > a50) AS above, count(*) AS total,
       CAST(round(100.0 * count(*) FILTER (WHERE close > a50) / count(*)) AS BIGINT) AS pct
FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING) AS a50, count(*) OVER (PARTITION BY symbol) AS n FROM
        (SELECT * FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 710 DAY))
WHERE pos = n_bars - 1 AND n >= 50 AND date >= (SELECT max(date) FROM bars) - INTERVAL 30 DAY"""))
def breadth(spark, sf):
    bars = standin.bar_table(spark, sf).withColumn("symbol", F.col("symbol").cast("string"))
    return pulse_plan.breadth(bars, fresh_days=30, history_days=710)

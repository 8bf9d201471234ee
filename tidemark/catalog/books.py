"""Day order of buys, value curves of closed trades and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import books
from ..plans import performance
from ..session import cut, stored
from ..sources import standin
from .base import query, with_views
from .market import rounded
from .outcomes import closed

VIEWS = {
    "moved": (["trades"], "SELECT *, exit_date + CASE isodow(exit_date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS o FROM trades"),
    "curve": (["moved"], """
        SELECT scanner, date, 1000000 * (1 + coalesce(CAST(sum(cents) OVER (PARTITION BY scanner ORDER BY date) AS DOUBLE), 0) / 10000::DOUBLE / n) AS value
        FROM (SELECT scanner, n, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
              FROM (SELECT scanner, count(*) AS n, min(entry_date) AS lo, max(o) AS hi FROM moved GROUP BY scanner)) d
        LEFT JOIN (SELECT scanner, o AS date, sum(CAST(round(ret * 100) AS BIGINT)) AS cents FROM moved GROUP BY ALL) p USING (scanner, date)
        WHERE isodow(date) < 6"""),
}


def trades(spark, sf):
    """Closed trades with a stand-in score for every third symbol."""
    rows = closed(spark, sf).select("scanner", "symbol", "hit_date", "tier", "entry_date", "exit_date", "ret", "status", "days")
    return rows.withColumn("score", F.when(F.col("symbol") % 3 == 0, (F.col("symbol") * 7 % 11) / 10.0))


def curve(spark, sf):
    return books.spread_curve(closed(spark, sf, told=()).select("scanner", "entry_date", "exit_date", "ret"), ["scanner"])


@query("day_order", "W15", with_views("trades", """
SELECT book, scanner, symbol, hit_date, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY book, entry_date ORDER BY g, p, scanner, symbol, hit_date) AS place FROM (
        SELECT *, CASE WHEN scored THEN 0 ELSE 1 END AS g, CASE WHEN scored THEN -((symbol * 7 % 11) / 10.0)
                      WHEN tier = 'Midcap' THEN 0 WHEN tier = 'Largecap' THEN 1 WHEN tier = 'Smallcap' THEN 2 ELSE 3 END AS p
        FROM (SELECT t.*, b.book, b.book = 'score' AND t.symbol % 3 = 0 AS scored FROM trades t, (VALUES ('tier'), ('score')) b(book))
        QUALIFY row_number() OVER (PARTITION BY book, entry_date, symbol ORDER BY g, p, scanner, symbol, hit_date) = 1)) WHERE place <= 15"""))
def day_order(spark, sf):
    return books.day_first(trades(spark, sf)).select("book", "scanner", "symbol", "hit_date", "place")


@query("equity_curve", "E10", with_views("curve", "SELECT scanner, date, round(value, 3) AS value FROM curve", VIEWS))
def equity_curve(spark, sf):
    return rounded(curve(spark, sf), 3, "value")


@query("equity_stats", "E11 W10", with_views("curve", """
SELECT scanner, min(date) AS start, max(date) AS end, round(arg_min(value, date), 3) AS first, round(arg_max(value, date), 3) AS last,
       round(min(value / peak - 1) * 100, 6) AS max_fall, round((pow(arg_max(value, date) / arg_min(value, date), 1 / (date_diff('day', min(date), max(date)) / 365.25)) - 1) * 100, 6) AS cagr
FROM (SELECT *, max(value) OVER (PARTITION BY scanner ORDER BY date) AS peak FROM curve) GROUP BY scanner""", VIEWS))
def equity_stats(spark, sf):
    return rounded(rounded(books.growth_stats(curve(spark, sf), ["scanner"]), 3, "first", "last"), 6, "max_fall", "cagr")


@query("yearly_against_index", "E12 W11 W17 J23", with_views("curve index_bars", """
SELECT b.scanner, b.year, round(b.ret, 6) AS ret, round(i.ret, 6) AS index_ret
FROM (SELECT scanner, year, (v / coalesce(lag(v) OVER (PARTITION BY scanner ORDER BY year), 1000000) - 1) * 100 AS ret
      FROM (SELECT scanner, year(date) AS year, arg_max(value, date) AS v FROM curve GROUP BY ALL)) b
LEFT JOIN (SELECT year, (v / coalesce(lag(v) OVER (ORDER BY year), f) - 1) * 100 AS ret
           FROM (SELECT year(date) AS year, arg_max(close, date) AS v, (SELECT arg_min(close, date) FROM index_bars WHERE date BETWEEN (SELECT min(date) FROM curve) AND (SELECT max(date) FROM curve)) AS f
                 FROM index_bars WHERE date BETWEEN (SELECT min(date) FROM curve) AND (SELECT max(date) FROM curve) GROUP BY ALL)) i USING (year)""", VIEWS))
def yearly_against_index(spark, sf):
    index = standin.index_bars(standin.bar_table(spark, sf)).withColumnRenamed("close", "value")
    return rounded(performance.years(cut(curve(spark, sf)), index), 6, "ret", "index_ret")


@query("monthly_against_index", "E12 W17 J23", with_views("curve index_bars", """
SELECT b.scanner, b.month, round(b.v, 3) AS value, round(i.v, 3) AS index_value
FROM (SELECT scanner, strftime(date, '%Y-%m') AS month, arg_max(value, date) AS v FROM curve GROUP BY ALL) b
LEFT JOIN (SELECT strftime(date, '%Y-%m') AS month, arg_max(close, date) / (SELECT arg_min(close, date) FROM index_bars WHERE date BETWEEN (SELECT min(date) FROM curve) AND (SELECT max(date) FROM curve)) * 1000000 AS v
           FROM index_bars WHERE date BETWEEN (SELECT min(date) FROM curve) AND (SELECT max(date) FROM curve) GROUP BY ALL) i USING (month)""", VIEWS))
def monthly_against_index(spark, sf):
    index = standin.index_bars(standin.bar_table(spark, sf)).withColumnRenamed("close", "value")
    return rounded(performance.months(cut(curve(spark, sf)), index), 3, "value", "index_value")


GRID = {"slots": [1, 3], "policies": ["tier", "score", "random"], "seeds": 20}


@query("scenario_grid", "J29 W15 E11", with_views("trades", """
SELECT slots, policy, seed, count(*) AS days, max(n) AS trades, round(arg_max(value, date), 3) AS last, round(min(value / peak - 1) * 100, 6) AS max_fall,
       round((pow(arg_max(value, date) / arg_min(value, date), 1 / (date_diff('day', min(date), max(date)) / 365.25)) - 1) * 100, 6) AS cagr
FROM (SELECT *, max(value) OVER (PARTITION BY slots, policy, seed ORDER BY date) AS peak FROM (
    SELECT slots, policy, seed, n, date, 1000000 * (1 + coalesce(CAST(sum(cents) OVER (PARTITION BY slots, policy, seed ORDER BY date) AS DOUBLE), 0) / 10000::DOUBLE / n) AS value
    FROM (SELECT slots, policy, seed, n, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT slots, policy, seed, count(*) AS n, min(entry_date) AS lo, max(o) AS hi FROM taken GROUP BY ALL)) d
    LEFT JOIN (SELECT slots, policy, seed, o AS date, sum(CAST(round(ret * 100) AS BIGINT)) AS cents FROM taken GROUP BY ALL) p USING (slots, policy, seed, date)
    WHERE isodow(date) < 6))
GROUP BY slots, policy, seed""".replace("FROM taken", """FROM (
    SELECT *, exit_date + CASE isodow(exit_date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS o FROM (
        SELECT *, row_number() OVER (PARTITION BY slots, policy, seed, entry_date ORDER BY lead, h, scanner) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY slots, policy, seed, entry_date, symbol ORDER BY lead, h, scanner) AS k FROM (
                SELECT t.*, g.*, md5(seed || '|' || scanner || '|' || symbol || '|' || hit_date) AS h,
                       CASE policy WHEN 'tier' THEN CASE tier WHEN 'Midcap' THEN 0 WHEN 'Largecap' THEN 1 WHEN 'Smallcap' THEN 2 ELSE 3 END
                                   WHEN 'score' THEN CASE WHEN symbol % 3 = 0 THEN -((symbol * 7 % 11) / 10.0) ELSE 1e9 END ELSE 0 END AS lead
                FROM trades t, (SELECT s AS slots, p AS policy, CAST(r AS INTEGER) AS seed FROM (VALUES (1), (3)) a(s), (VALUES ('tier'), ('score'), ('random')) b(p), range(20) c(r)) g))
        WHERE k = 1) WHERE place <= slots)"""), VIEWS))
def scenario_grid(spark, sf):
    """Growth of evenly spread books under 2 x 3 x 20 orders of a day's buys."""
    by = ["slots", "policy", "seed"]
    taken = cut(books.scenarios(stored(trades(spark, sf)), **GRID).select(*by, "entry_date", "exit_date", "ret"))
    curves = cut(books.spread_curve(taken, by))
    sizes = taken.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"))
    days = curves.groupBy(*by).agg(F.count(F.lit(1)).alias("days"))
    out = books.growth_stats(curves, by).join(sizes, by).join(days, by).select(*by, "days", "trades", "last", "max_fall", "cagr")
    return rounded(rounded(out, 3, "last"), 6, "max_fall", "cagr")

"""Field extraction from pages, statements and announcements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import pages as page_source
from ..sources import standin
from .base import query, with_views
from .fundamentals import RATIOS


@query("page_fields", "S10 X4", r"""
SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(title, '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
       trim(regexp_replace(regexp_replace(replace(heading, '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading, lang,
       CAST(len(items) AS INTEGER) AS items, items[1] AS first_item, CAST(len(links) AS INTEGER) AS links, CAST(len(list_distinct(links)) AS INTEGER) AS targets
FROM (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's') AS heading,
             regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links,
             list_filter(list_transform(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 's'), lambda x: trim(regexp_replace(regexp_replace(replace(x, '&nbsp;', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS items
      FROM pages)""")
def page_fields(spark, sf):
    return page_source.page_fields(standin.table(spark, sf, "pages"))


@query("page_statements", "S10 F27 C2", with_views("arrays", """
SELECT code AS page_id, CASE WHEN code % 4 = 1 THEN 'b' ELSE 'a' END AS variant, s_name AS name, round(net_income[1] / 1e4, 0) AS pat, round(debt[1] / 1e4, 0) AS debt, round(debt[1] / 1e4, 0) - round(debt[2] / 1e4, 0) + 0.0 AS debt_change,
       CASE WHEN round(revenue[2] / 1e4, 0) > 0 THEN CAST(printf('%.1f', (round(revenue[1] / 1e4, 0) / round(revenue[2] / 1e4, 0) - 1) * 100) AS DOUBLE) END AS sales1y, CAST(code % 900 + 1000 AS DOUBLE) AS mcap
FROM arrays JOIN supplier ON s_suppkey = code WHERE code % 4 <> 3""", RATIOS))
def page_statements(spark, sf):
    """Statement pages written from supplier years, in two variants, and read back."""
    yearly = standin.company(spark, sf)
    row = F.struct(
        F.col("year"), F.round(F.col("gross") / 1e4, 0).cast("long").alias("sales"),
        F.round((F.col("cut") - F.col("tax")) / 1e4, 0).cast("long").alias("profit"),
        F.round(F.col("units") * 1000 / 1e4, 0).cast("long").alias("debt"),
    )
    # A company has one row per year.
    years = yearly.groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("y"))
    named = years.join(standin.table(spark, sf, "supplier"), F.col("symbol") == F.col("s_suppkey"))

    def cells(field: str):
        return F.array_join(F.transform("y", lambda r: F.concat(F.lit("<td> "), F.format_string("%,d", r[field]), F.lit(" </td>"))), "")

    heads = F.array_join(F.transform("y", lambda r: F.concat(F.lit("<th> Mar "), r["year"].cast("string"), F.lit(" </th>"))), "")
    table = F.concat(F.lit('<table class="data-table"><thead><tr><th></th>'), heads, F.lit("<th>TTM</th></tr></thead><tbody>"))
    loss = F.concat(
        F.lit('<section id="profit-loss">'), table, F.lit('<tr><td><button>Sales&nbsp;<i>+</i></button></td>'), cells("sales"), F.lit("<td>1</td></tr>"),
        F.lit("<tr><td>Net Profit</td>"), cells("profit"), F.lit("<td>1</td></tr></tbody></table></section>"),
    )
    sheet = F.concat(
        F.lit('<section id="balance-sheet">'), table, F.lit("<tr><td>Borrowings&nbsp;+</td>"), cells("debt"), F.lit("</tr></tbody></table></section>"),
    )
    top = F.concat(
        F.lit('<ul id="top-ratios"><li><span class="name"> Market Cap </span> ₹ <span class="number">'),
        F.format_string("%,d", F.col("symbol") % 900 + 1000), F.lit("</span> Cr.</li></ul>"),
    )
    head = F.concat(F.lit("<html><h1>"), F.col("s_name"), F.lit("</h1>"))
    full, bare = F.concat(head, top, loss, sheet), F.concat(head, top)
    empty = F.concat(head, F.lit("</html>"))
    # Residue 1 has figures on the second variant only, residue 3 nowhere.
    kind = F.col("symbol") % 4
    variants = F.array(
        F.struct(F.lit("a").alias("variant"), F.when(kind == 1, bare).when(kind == 3, empty).otherwise(full).alias("html")),
        F.struct(F.lit("b").alias("variant"), F.when(kind == 1, full).otherwise(empty).alias("html")),
    )
    pages = named.select("symbol", F.explode(variants).alias("v")).select(
        F.struct("symbol", "v.variant").alias("page_id"), "v.html"
    )
    rows = page_source.company_rows(pages).select(
        F.col("page_id.symbol").alias("page_id"), F.col("page_id.variant").alias("variant"), "name", "pat", "debt", "debt_change", "sales1y", "mcap"
    )
    return page_source.best_variant(rows, "page_id", "variant")


@query("board_meetings", "S11 X4 D1", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + 6 * 365 AS day, CASE WHEN o_orderpriority < '3' THEN 'results' ELSE 'board meeting' END AS what
FROM orders WHERE o_orderkey % 7 <> 0""")
def board_meetings(spark, sf):
    """Announcements written from orders in three date styles; an earlier date stands beside the meeting's."""
    orders = standin.table(spark, sf, "orders")
    day = F.date_add(F.to_date("o_orderdate"), 6 * 365)
    early = F.date_sub(day, 20)
    style = F.col("o_orderkey") % 3
    written = (
        F.when(style == 0, F.concat(F.date_format(day, "d"), F.lit("th of "), F.date_format(day, "MMMM, yyyy")))
        .when(style == 1, F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    why = F.when(F.col("o_orderpriority") < "3", " to approve the Results").otherwise(" to raise funds")
    opening = F.when(F.col("o_orderkey") % 7 == 0, "Press note of ").otherwise("Intimation of the Board  Meeting, notice of ")
    text = F.concat(opening, F.date_format(early, "dd-MM-yyyy"), F.lit(", set for "), written, why)
    # Meetings fall after 2000, as the date forms ask for.
    items = orders.select("o_orderkey", text.alias("text"))
    return page_source.board_meetings(items).select("o_orderkey", "day", "what")

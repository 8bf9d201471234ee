"""Company exports, screens, scores and rankings derived from suppliers and their sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import currency_to_number
from ..operators import keys
from ..plans import fundamentals as fund
from ..sources import standin
from ..sources.files import rows_by_code, statement_fields
from .base import query, with_views
from .market import rounded

# Parts act as companies: many rows, and every figure is a whole-number function of the
# key, written as text the way an export has it, with blanks here and there.
FIELDS = {
    "Current Price": ("1 + k % 97 * 5", "k % 23"), "High price": ("100 + k % 89 * 4", "k % 29"),
    "Market Capitalization": ("20 + k * 13 % 9000", "k % 31"), "Price to Earning": ("k % 47 - 3", "k % 3"),
    "Return on capital employed": ("k * 7 % 45", "k % 19"), "Return on equity": ("k * 5 % 40", "k % 17"),
    "Debt to equity": ("k * 3 % 29 / 10.0", "k % 4"), "Promoter holding": ("20 + k * 11 % 60", "k % 13"),
    "Pledged percentage": ("k % 2", "k % 5"), "OPM": ("k * 3 % 25", "k % 37"),
    "Sales growth 3Years": ("k % 53 - 8", "k % 6"), "Sales growth": ("k % 61 - 10", "k % 41"),
    "Profit growth 3Years": ("k % 71 - 10", "k % 7"), "Profit growth": ("k * 17 % 700 - 50", "k % 11"),
    "YOY Quarterly profit growth": ("k * 19 % 260 - 60", "k % 8"), "Profit after tax": ("k * 29 % 400 - 40", "k % 43"),
    "CFO": ("k * 31 % 500 - 80", "k % 9"), "Debt": ("k * 37 % 900", "k % 10"), "Debt Change": ("k * 41 % 700 - 200", "k % 14"),
    "Debtor days": ("k * 43 % 220", "k % 15"), "Debtor Days Ch": ("k * 47 % 80 - 40", "k % 16"),
}
SHORT = {
    "Current Price": "price", "High price": "high", "Market Capitalization": "mcap", "Price to Earning": "pe",
    "Return on capital employed": "roce", "Return on equity": "roe", "Debt to equity": "de", "Promoter holding": "promoter",
    "Pledged percentage": "pledge", "OPM": "opm", "Sales growth 3Years": "sales3y", "Sales growth": "sales1y",
    "Profit growth 3Years": "profit3y", "Profit growth": "profit1y", "YOY Quarterly profit growth": "profit_q",
    "Profit after tax": "pat", "CFO": "cfo", "Debt": "debt", "Debt Change": "debt_change", "Debtor days": "debtor_days",
    "Debtor Days Ch": "debtor_days_ch",
}


def export(spark, sf):
    """Export rows as text: thousands separators, blanks, an industry and a code."""
    parts = standin.table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    cells = {}
    for name, (value, gap) in FIELDS.items():
        written = F.format_string("%,.1f", F.expr(f"CAST({value} AS DOUBLE)"))
        cells[name] = F.when(F.expr(f"{gap} = 0"), F.lit(" ")).otherwise(written)
    return parts.select(
        F.concat(F.lit(" P"), "k").alias("NSE Code"), F.col("p_name").alias("Name"),
        F.when(F.col("k") % 12 == 0, "Private Bank").otherwise(F.col("p_type")).alias("Industry"),
        *[c.alias(n) for n, c in cells.items()],
    )


def companies(spark, sf):
    return fund.fields(export(spark, sf)).withColumn("code", F.col("nse"))


_COLUMNS = ", ".join(
    f"CASE WHEN {gap} = 0 THEN NULL ELSE CAST({value} AS DOUBLE) END AS {SHORT[name]}" for name, (value, gap) in FIELDS.items()
)
COMPANY = {
    "base": ([], f"""
        SELECT 'P' || k AS code, p_name AS name, CASE WHEN k % 12 = 0 THEN 'Private Bank' ELSE p_type END AS industry, k % 12 = 0 AS bank, {_COLUMNS}
        FROM (SELECT *, p_partkey AS k FROM part)"""),
    "score_in": (["base"], """
        SELECT *, CASE WHEN NOT bank THEN promoter END AS v_promoter, CASE WHEN NOT bank THEN debtor_days END AS v_days, CASE WHEN NOT bank THEN debtor_days_ch END AS v_days_ch,
               coalesce(pe, CASE WHEN pat > 0 THEN mcap / pat END) AS pe_used, coalesce(sales3y, sales1y) AS g,
               coalesce(pat <= 0, false) OR coalesce(pe <= 0, false) AS loss, CASE WHEN pat > 0 THEN cfo / pat END AS cfo_pat,
               CASE WHEN price <> 0 AND high <> 0 THEN (price / high - 1) * 100 END AS from_high,
               CASE WHEN debt IS NOT NULL AND pat IS NOT NULL THEN CASE WHEN pat > 0 THEN debt / pat ELSE 99 END END AS debt_pat FROM base"""),
    "bands": (["score_in"], """
        SELECT *, CASE WHEN g IS NOT NULL THEN len(list_filter([5, 10, 15, 25, 40], lambda t: g >= t)) END AS s_sales_growth,
               CASE WHEN coalesce(roce, roe) IS NOT NULL THEN len(list_filter([8, 12, 16, 20, 30], lambda t: coalesce(roce, roe) >= t)) END AS s_cap_eff,
               CASE WHEN loss THEN 0 WHEN pe_used > 0 AND g > 0 THEN len(list_filter([3.0, 2.0, 1.5, 1.0, 0.7], lambda t: pe_used / g <= t::DOUBLE)) END AS s_valuation,
               CASE WHEN de IS NOT NULL THEN len(list_filter([2.0, 1.0, 0.5, 0.25, 0.10], lambda t: de <= t::DOUBLE)) WHEN debt_pat IS NOT NULL THEN len(list_filter([5, 3, 2, 1, 0.5], lambda t: debt_pat <= t::DOUBLE)) END AS s_balance,
               CASE WHEN v_promoter IS NOT NULL THEN len(list_filter([30, 40, 50, 60, 70], lambda t: v_promoter >= t)) END AS s_promoter,
               CASE WHEN mcap IS NOT NULL THEN len(list_filter([50000, 10000, 3000, 1000, 500], lambda t: mcap <= t)) END AS s_size,
               CASE WHEN coalesce(profit3y, profit1y) IS NOT NULL THEN len(list_filter([0, 10, 20, 35, 50], lambda t: coalesce(profit3y, profit1y) >= t)) END AS s_momentum FROM score_in"""),
    "weights": (["bands"], """
        SELECT *, CASE WHEN s_sales_growth IS NULL THEN 0 ELSE 0.15::DOUBLE END AS w1, CASE WHEN s_cap_eff IS NULL THEN 0 ELSE 0.15::DOUBLE END AS w2, CASE WHEN s_valuation IS NULL THEN 0 ELSE 0.10::DOUBLE END AS w3,
               CASE WHEN s_balance IS NULL THEN 0 ELSE 0.10::DOUBLE END AS w4, CASE WHEN s_promoter IS NULL THEN 0 ELSE 0.10::DOUBLE END AS w5, CASE WHEN s_size IS NULL THEN 0 ELSE 0.10::DOUBLE END AS w6, CASE WHEN s_momentum IS NULL THEN 0 ELSE 0.05::DOUBLE END AS w7,
               CASE WHEN theme IS NULL THEN 0 ELSE 0.15::DOUBLE END AS w8, CASE WHEN niche IS NULL THEN 0 ELSE 0.10::DOUBLE END AS w9
        FROM (SELECT *, CASE WHEN {manual} AND CAST(substr(code, 2) AS BIGINT) % 5 = 0 THEN CAST(substr(code, 2) AS BIGINT) % 6 END AS theme, CASE WHEN {manual} AND CAST(substr(code, 2) AS BIGINT) % 10 = 0 THEN CAST(substr(code, 2) AS BIGINT) % 4 END AS niche FROM bands)"""),
    "totals": (["weights"], """
        SELECT *, CASE WHEN have > 0 THEN (w1 * coalesce(s_sales_growth, 0) + w2 * coalesce(s_cap_eff, 0) + w3 * coalesce(s_valuation, 0) + w4 * coalesce(s_balance, 0) + w5 * coalesce(s_promoter, 0) + w6 * coalesce(s_size, 0) + w7 * coalesce(s_momentum, 0) + w8 * coalesce(theme, 0) + w9 * coalesce(niche, 0)) / have * 20 END AS score0,
               have / (0.75 + w8 + w9) AS coverage0
        FROM (SELECT *, w1 + w2 + w3 + w4 + w5 + w6 + w7 + w8 + w9 AS have FROM weights)"""),
    "flagged": (["totals"], """
        SELECT *, round(score0, 6) AS score, round(coverage0, 6) AS coverage, concat_ws('; ', CASE WHEN cfo_pat < 0.5 THEN 'weak cash conversion' END, CASE WHEN cfo < 0 THEN 'negative CFO' END, CASE WHEN v_days > 120 THEN 'high debtor days' END,
               CASE WHEN v_days_ch > 20 THEN 'debtor days rising' END, CASE WHEN debt > 0 AND debt_change > debt * 0.5 THEN 'debt jumped' END, CASE WHEN profit1y > 500 THEN 'one-off profit spike?' END) AS flags FROM totals"""),
    "verdicts": (["flagged"], """
        SELECT *, CASE WHEN v <> '' AND coverage0 < 0.70 THEN v || ' (low data)' ELSE v END AS verdict,
               CASE WHEN from_high IS NULL THEN '' WHEN from_high <= -20 THEN 'dip zone' ELSE 'near high: wait for dip/results' END AS entry
        FROM (SELECT *, CASE WHEN score0 IS NULL THEN '' WHEN v_promoter < 30 THEN 'Reject: low promoter' WHEN score0 >= 65 THEN CASE WHEN flags = '' THEN 'Shortlist' ELSE 'Shortlist - check flags' END WHEN score0 >= 50 THEN 'Maybe' ELSE 'Skip' END AS v FROM flagged)"""),
    "screens": (["base"], """
        SELECT code, bank, CAST(len(list_filter(r, lambda x: x.p)) AS INTEGER) AS passed, CAST(len(list_filter(r, lambda x: x.p IS NOT NULL)) AS INTEGER) AS checked,
               array_to_string(list_transform(list_filter(r, lambda x: NOT x.p), lambda x: x.l), ',') AS fails, replace(array_to_string(list_transform(list_filter(r, lambda x: x.p IS NULL), lambda x: x.l), ','), 'ROE', 'ROCE') AS unknown
        FROM (SELECT code, bank, [{{'l': 'Near 52w high', 'p': CASE WHEN price <> 0 AND high <> 0 THEN price / high * 100 > 80 END}}, {{'l': 'Market cap', 'p': mcap > 100 AND mcap < 5000}},
               {{'l': CASE WHEN {roe} AND bank THEN 'ROE' ELSE 'ROCE' END, 'p': CASE WHEN {roe} AND bank THEN roe > 15 ELSE roce > 15 END}}, {{'l': 'OPM', 'p': CASE WHEN {roe} AND bank THEN NULL ELSE opm > 5 END}}, {{'l': 'Debt/equity', 'p': CASE WHEN {roe} AND bank THEN NULL ELSE de < 1.1 END}},
               {{'l': 'Pledge', 'p': pledge = 0}}, {{'l': 'Promoter', 'p': promoter > 55}},
               {{'l': 'Profit growth', 'p': CASE WHEN profit1y IS NULL AND profit_q IS NULL THEN NULL ELSE coalesce(profit1y > 40, false) OR coalesce(profit_q > 100, false) END}},
               {{'l': 'Debtor days', 'p': CASE WHEN {roe} AND bank THEN NULL ELSE debtor_days < 150 END}}, {{'l': 'P/E', 'p': {pe} > 0 AND {pe} < 20}}] AS r FROM base)"""),
}


def views(manual=False, roe=False, pe="pe"):
    fill = {"manual": "true" if manual else "false", "roe": "true" if roe else "false", "pe": pe}
    return {
        k: (deps, sql.format(**fill) if k in ("weights", "screens") else sql) for k, (deps, sql) in COMPANY.items()
    }


@query("export_fields", "F24 C1 S1", with_views("base", "SELECT code, name, industry, bank, price, mcap, de, profit1y FROM base", views()))
def export_fields(spark, sf):
    rows = companies(spark, sf).withColumn("bank", fund.is_bank(F.col("industry")))
    return rows.select("code", "name", "industry", "bank", "price", "mcap", "de", "profit1y")


@query("currency_text", "C2 C1", """
SELECT c_custkey, c_acctbal AS amount, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS maybe FROM customer""")
def currency_text(spark, sf):
    c = standin.table(spark, sf, "customer")
    written = F.concat(F.lit("₹ "), F.format_string("%,.2f", "c_acctbal"), F.lit(" Cr."))
    odd = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(written)
    return c.select("c_custkey", currency_to_number(written).alias("amount"), currency_to_number(odd).alias("maybe"))


@query("band_scores", "M4 M5", with_views("bands", """
SELECT code, CAST(s_sales_growth AS INTEGER) AS s_sales_growth, CAST(s_cap_eff AS INTEGER) AS s_cap_eff, CAST(s_valuation AS INTEGER) AS s_valuation, CAST(s_balance AS INTEGER) AS s_balance,
       CAST(s_promoter AS INTEGER) AS s_promoter, CAST(s_size AS INTEGER) AS s_size, CAST(s_momentum AS INTEGER) AS s_momentum FROM bands""", views()))
def band_scores(spark, sf):
    out = fund.scored(fund.bank_adjusted(companies(spark, sf), for_score=True))
    return out.select("code", *[f"s_{k}" for k in ("sales_growth", "cap_eff", "valuation", "balance", "promoter", "size", "momentum")])


@query("score_verdict", "A25 F15 F16 F17 E20 J26", with_views("verdicts", "SELECT code, score, coverage, flags, verdict, entry FROM verdicts", views(manual=True)))
def score_verdict(spark, sf):
    # Judgement scores: a small table by code, for some companies only.
    parts = standin.table(spark, sf, "part").where("p_partkey % 5 = 0")
    manual = parts.select(
        F.concat(F.lit("P"), "p_partkey").alias("code"), (F.col("p_partkey") % 6).cast("int").alias("theme"),
        F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey") % 4).cast("int").alias("niche"),
    )
    rows = fund.bank_adjusted(companies(spark, sf).join(manual, "code", "left"), for_score=True)
    return rounded(fund.scored(rows), 6, "score", "coverage").select("code", "score", "coverage", "flags", "verdict", "entry")


@query("screen_ten", "F12 F13 F14 F18 X1", with_views("screens", """
SELECT code, passed, checked, fails, unknown, fails = '' AND checked >= 7 AS ok FROM screens""", views(roe=True)))
def screen_ten(spark, sf):
    out = fund.screened(fund.bank_adjusted(companies(spark, sf)))
    return out.select(
        "code", "passed", "checked", F.array_join("fail_labels", ",").alias("fails"), F.array_join("unknown", ",").alias("unknown"), "ok"
    )


@query("company_check", "E19 F18 F19", with_views("screens verdicts", """
SELECT v.code, CASE WHEN CAST(substr(v.code, 2) AS BIGINT) % 3 = 0 THEN 'page' ELSE 'export' END AS origin, v.verdict,
       CASE WHEN CAST(substr(v.code, 2) AS BIGINT) % 3 <> 0 THEN v.pe END AS pe,
       CASE WHEN CAST(substr(v.code, 2) AS BIGINT) % 3 = 0 THEN array_to_string(list_transform(list_filter(string_split(s.fails, ','), lambda x: x <> ''), lambda x: x || ' fails'), ',') ELSE s.fails END AS fails
FROM verdicts0 v JOIN screens s ON s.code = v.code""".replace("verdicts0", "verdicts"), views(roe=True) | {
    # Banks are scored on ROE in place of ROCE, and without D/E.
    "score_in": (["base"], COMPANY["score_in"][1].replace("FROM base", "FROM (SELECT * REPLACE (CASE WHEN bank THEN roe ELSE roce END AS roce, CASE WHEN bank THEN NULL ELSE de END AS de) FROM base)")),
}))
def company_check(spark, sf):
    rows = companies(spark, sf).withColumn("__k", F.substring("code", 2, 20).cast("long"))
    named = rows.withColumn("origin", F.when(F.col("__k") % 3 == 0, "page").otherwise("export"))
    out = fund.redacted(fund.checked(named))
    return out.select("code", "origin", "verdict", "pe", F.array_join("fails", ",").alias("fails"))


@query("ranked_universe", "E21 W16", with_views("verdicts screens", """
SELECT v.code, row_number() OVER (ORDER BY CAST(printf('%.1f', v.score0) AS DOUBLE) DESC NULLS LAST, v.code) AS rank, v.verdict, s.passed, s.fails
FROM verdicts v JOIN screens s ON s.code = v.code""", views(pe="coalesce(pe, CASE WHEN pat > 0 THEN CAST(printf('%.1f', mcap / pat) AS DOUBLE) END)")))
def ranked_universe(spark, sf):
    out = fund.ranked_universe(companies(spark, sf))
    return out.select("code", "rank", "verdict", "passed", F.array_join("fail_labels", ",").alias("fails"))


@query("shortlist", "L7", with_views("verdicts", """
SELECT code, verdict FROM (SELECT *, row_number() OVER (PARTITION BY starts_with(verdict, 'Shortlist - check') ORDER BY rank) AS n FROM (
    SELECT *, row_number() OVER (ORDER BY CAST(printf('%.1f', score0) AS DOUBLE) DESC NULLS LAST, code) AS rank FROM verdicts)
    WHERE verdict = 'Shortlist' OR starts_with(verdict, 'Shortlist - check'))
WHERE n <= CASE WHEN verdict = 'Shortlist' THEN 8 ELSE 5 END""", views()))
def shortlist(spark, sf):
    return fund.shortlist(fund.ranked_universe(companies(spark, sf))).select("code", "verdict")


@query("clean_ten", "L7", with_views("verdicts", """
SELECT code, rank FROM (SELECT *, row_number() OVER (ORDER BY CAST(printf('%.1f', score0) AS DOUBLE) DESC NULLS LAST, code) AS rank FROM verdicts)
WHERE verdict = 'Shortlist' ORDER BY rank LIMIT 10""", views()))
def clean_ten(spark, sf):
    return fund.shortlist(fund.ranked_universe(companies(spark, sf)), clean=10, flagged=0).select("code", "rank")


@query("overlay", "J20 J21 S3", """
WITH e AS (SELECT 'P' || (p_partkey % 500) AS code, last(p_name ORDER BY p_partkey) AS name, last(CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END ORDER BY p_partkey) AS size FROM part GROUP BY 1
           UNION ALL SELECT 'B' || (p_partkey % 300) AS code, last(p_name ORDER BY p_partkey), last(CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END ORDER BY p_partkey) FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
a AS (SELECT 'P' || (s_suppkey * 9) AS code, s_name AS name, CAST(s_nationkey AS VARCHAR) AS size FROM supplier)
SELECT coalesce(e.code, a.code) AS code, CASE WHEN e.code IS NOT NULL AND a.code IS NOT NULL THEN 'export + page' WHEN e.code IS NOT NULL THEN 'export' ELSE 'page' END AS origin,
       coalesce(nullif(trim(e.name), ''), a.name) AS name, coalesce(nullif(trim(e.size), ''), a.size) AS size
FROM e FULL JOIN a ON a.code = e.code""")
def overlay(spark, sf):
    k = F.col("p_partkey")
    rows = standin.table(spark, sf, "part").select(
        F.concat(F.lit("p"), k % 500).alias("NSE Code"), F.when(k % 2 == 0, F.concat(F.lit("b"), k % 300)).alias("BSE Code"),
        F.col("p_name").alias("name"), F.when(k % 4 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("size"), k.alias("row"),
    )
    by_code = rows_by_code(rows, ["NSE Code", "BSE Code"], ["row"]).select("code", "name", "size")
    auto = standin.table(spark, sf, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey") * 9).alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("size")
    )
    return fund.overlay(by_code, auto, F.lit("page")).select("code", "origin", "name", "size")


RATIOS = {
    "yearly": ([], """
        SELECT l_suppkey AS symbol, year(l_shipdate) AS y, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross, CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS cut,
               CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS tax, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
        FROM lineitem GROUP BY ALL"""),
    "arrays": (["yearly"], """
        SELECT symbol AS code, list(CAST(gross AS DOUBLE) ORDER BY y DESC) AS revenue, list(CAST(cut - tax AS DOUBLE) ORDER BY y DESC) AS net_income, list(CAST(cut AS DOUBLE) ORDER BY y DESC) AS ebit,
               list(CAST(gross * 2 AS DOUBLE) ORDER BY y DESC) AS assets, list(CAST(tax AS DOUBLE) ORDER BY y DESC) AS liabilities, list(CAST(units * 1000 AS DOUBLE) ORDER BY y DESC) AS debt,
               list(CAST(tax * 3 AS DOUBLE) ORDER BY y DESC) AS receivables, list(CAST(cut AS DOUBLE) ORDER BY y DESC) AS cash_flow FROM yearly GROUP BY symbol"""),
}


@query("ratio_derive", "M1 M2 M3 S12 R1", with_views("arrays", """
SELECT code, CASE WHEN assets[1] - liabilities[1] > 0 THEN CAST(printf('%.1f', ebit[1] / (assets[1] - liabilities[1]) * 100) AS DOUBLE) END AS roce,
       CASE WHEN revenue[1] > 0 AND revenue[4] > 0 THEN CAST(printf('%.1f', (pow(revenue[1] / revenue[4], 1.0 / 3) - 1) * 100) AS DOUBLE) END AS sales3y,
       CASE WHEN net_income[1] > 0 AND net_income[4] > 0 THEN CAST(printf('%.1f', (pow(net_income[1] / net_income[4], 1.0 / 3) - 1) * 100) AS DOUBLE) END AS profit3y,
       CASE WHEN revenue[2] > 0 THEN CAST(printf('%.1f', (revenue[1] / revenue[2] - 1) * 100) AS DOUBLE) END AS sales1y, CASE WHEN net_income[2] > 0 THEN CAST(printf('%.1f', (net_income[1] / net_income[2] - 1) * 100) AS DOUBLE) END AS profit1y,
       CASE WHEN net_income[5] > 0 THEN CAST(printf('%.1f', (net_income[1] / net_income[5] - 1) * 100) AS DOUBLE) END AS profit_q, CAST(printf('%.1f', net_income[1] / 1e7) AS DOUBLE) AS pat, CAST(printf('%.1f', cash_flow[1] / 1e7) AS DOUBLE) AS cfo, CAST(printf('%.1f', debt[1] / 1e7) AS DOUBLE) AS debt,
       CAST(printf('%.1f', (debt[1] - debt[2]) / 1e7) AS DOUBLE) AS debt_change, CAST(printf('%.1f', receivables[1] / revenue[1] * 365) AS DOUBLE) AS debtor_days,
       CAST(printf('%.1f', CAST(printf('%.1f', receivables[1] / revenue[1] * 365) AS DOUBLE) - CAST(printf('%.1f', receivables[2] / revenue[2] * 365) AS DOUBLE)) AS DOUBLE) AS debtor_days_ch, CAST(printf('%.1f', ebit[1] / revenue[1] * 100) AS DOUBLE) AS opm FROM arrays""", RATIOS))
def ratio_derive(spark, sf):
    yearly = standin.company(spark, sf)
    lines = {
        "Total Revenue": F.col("gross"), "Net Income": F.col("cut") - F.col("tax"), "Operating Income": F.col("cut"),
        "Total Assets": F.col("gross") * 2, "Current Liabilities": F.col("tax"), "Total Debt": F.col("units") * 1000,
        "Receivables": F.col("tax") * 3, "Operating Cash Flow": F.col("cut"),
    }
    long = yearly.select(
        "symbol", (-F.col("year")).alias("period_rank"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.cast("double").alias("value")) for k, v in lines.items()])).alias("l"),
    ).select("symbol", "period_rank", "l.label", "l.value")
    wanted = {
        "revenue": ["Total Revenue", "Operating Revenue"], "net_income": ["Net Income", "Net Income Common Stockholders"],
        "ebit": ["EBIT", "Operating Income"], "assets": ["Total Assets"], "liabilities": ["Current Liabilities"],
        "debt": ["Total Debt"], "receivables": ["Accounts Receivable", "Receivables"],
        "cash_flow": ["Operating Cash Flow", "Cash Flow From Continuing Operating Activities"],
    }
    shaped = statement_fields(long, wanted).withColumnRenamed("symbol", "code").withColumns(
        {"quarterly_income": F.col("net_income"), "op_margin": F.lit(None).cast("double")}
    )
    return fund.statement_ratios(shaped)


@query("refresh_due", "K6 S14", """
SELECT s_suppkey AS symbol, CASE WHEN f IS NULL THEN 'absent' WHEN date_diff('day', CAST(f AS DATE), DATE '2024-02-15') >= 16 THEN 'old'
       WHEN k % 3 = 0 THEN 'field missing' WHEN k % 5 = 0 THEN 'older parser' END AS why
FROM supplier LEFT JOIN (SELECT user_id, max(ts) AS f, max(event_id) AS k FROM events WHERE event_type = 'signup' GROUP BY user_id) c ON user_id = s_suppkey
WHERE f IS NULL OR date_diff('day', CAST(f AS DATE), DATE '2024-02-15') >= 16 OR k % 3 = 0 OR k % 5 = 0""")
def refresh_due(spark, sf):
    cache = standin.table(spark, sf, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("symbol")).agg(
        F.max("ts").alias("fetched_at"), F.max("event_id").alias("k")
    )
    cells = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("Name"), F.lit("x"))).otherwise(F.create_map(F.lit("OPM"), F.lit("1")))
    stored = cache.withColumns({"cells": cells, "parser_version": F.when(F.col("k") % 5 == 0, 1).otherwise(2)})
    wanted = standin.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return keys.refresh_due(wanted, stored, "symbol", F.lit("2024-02-15").cast("date"), 16, "OPM", 2)

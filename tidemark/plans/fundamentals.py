"""Company fundamentals: field extraction, screen, score, flags, verdict and ranking.

A company is one row; each step is a projection over its columns, so the whole chain
runs in one stage without a shuffle until rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text
from ..functions.numbers import band, cagr, growth, round_binary, to_number, with_rounded
from ..operators.ordering import global_row_number


def fields(rows: DataFrame) -> DataFrame:
    """Logical fields from an export with any subset of the known columns; first non-blank name wins."""
    def pick(names: list[str]) -> Column:
        have = [F.col(f"`{n}`") for n in names if n in rows.columns]
        return text.first_filled(have) if have else F.lit(None).cast("string")

    columns = {k: pick(v) for k, v in config.TEXT_FIELDS.items()}
    columns |= {k: to_number(pick(v), r"[,\s]") for k, v in config.NUMBER_FIELDS.items()}
    kept = [c for c in rows.columns if c not in {n for v in (config.TEXT_FIELDS | config.NUMBER_FIELDS).values() for n in v}]
    return rows.select(*kept, *[c.alias(k) for k, c in columns.items()])


def is_bank(industry: Column) -> Column:
    return F.coalesce(F.lower(industry).contains("bank"), F.lit(False))


def bank_adjusted(rows: DataFrame, for_score: bool = False) -> DataFrame:
    """Blank what does not apply to banks; they are checked on ROE, and scored without promoter."""
    bank = is_bank(F.col("industry"))
    blank = ["debtor_days", "debtor_days_ch"] + (["promoter"] if for_score else ["opm", "de"])
    out = {c: F.when(~bank, F.col(c)) for c in blank}
    if not for_score:
        out["roce"] = F.when(bank, F.col("roe")).otherwise(F.col("roce"))
    return rows.withColumns(out | {"bank": bank})


def screen_rules(rules: list[tuple[str, str, str]] = config.SCREEN_RULES) -> list[tuple[str, Column, Column]]:
    """Rules as (label, whether it could be checked, whether it passes), from rows of text."""
    return [(label, F.coalesce(F.expr(known), F.lit(False)), F.expr(test)) for label, known, test in rules]


def screened(rows: DataFrame, rules: list[tuple[str, str, str]] = config.SCREEN_RULES) -> DataFrame:
    """Add passed, checked, total, fail_labels, unknown and ok: no fails among at least seven checks."""
    rules = screen_rules(rules)
    passed = sum((F.when(known & test, 1).otherwise(0) for _, known, test in rules), F.lit(0))
    checked = sum((known.cast("int") for _, known, _ in rules), F.lit(0))
    fails = F.array(*[F.when(known & ~test, F.lit(label)) for label, known, test in rules])
    unknown = F.array(*[F.when(~known, F.lit(label)) for label, known, _ in rules])
    labels = F.filter(fails, lambda x: x.isNotNull())
    if "bank" in rows.columns:
        labels = F.transform(labels, lambda x: F.when((x == "ROCE") & F.col("bank"), F.lit("ROE")).otherwise(x))
    out = rows.withColumns(
        {
            "passed": passed, "checked": checked, "total": F.lit(len(rules)), "fail_labels": labels,
            "unknown": F.filter(unknown, lambda x: x.isNotNull()),
        }
    )
    return out.withColumn("ok", (F.size("fail_labels") == 0) & (F.col("checked") >= config.MIN_CHECKED))


def derived(rows: DataFrame) -> DataFrame:
    """P/E from size and profit where absent, growth, PEG, debt and cash against profit, fall from the high."""
    c = F.col
    pe = F.coalesce(c("pe"), F.when(c("pat") > 0, c("mcap") / c("pat")))
    rate = F.coalesce("sales3y", "sales1y")
    return rows.withColumns(
        {
            "loss_making": F.coalesce(c("pat") <= 0, F.lit(False)) | F.coalesce(c("pe") <= 0, F.lit(False)),
            "pe_used": pe,
            "growth_used": rate,
            "peg": F.when((pe > 0) & (rate > 0), pe / rate),
            "debt_pat": F.when(c("debt").isNotNull() & c("pat").isNotNull(), F.when(c("pat") > 0, c("debt") / c("pat")).otherwise(99.0)),
            "cfo_pat": F.when(c("pat") > 0, c("cfo") / c("pat")),
            "from_high": F.when((c("price") != 0) & (c("high") != 0), (c("price") / c("high") - 1) * 100),
        }
    )


def factor_scores() -> dict[str, tuple[Column, Column]]:
    """Each factor's band score and weight."""
    c, f = F.col, config.FACTORS

    def of(name: str, value: Column) -> tuple[Column, Column]:
        weight, direction, marks = f[name]
        return band(value, direction, marks), F.lit(weight)

    valuation, weight = of("valuation", c("peg"))
    de, de_weight = of("balance_de", c("de"))
    dpat, dpat_weight = of("balance_dpat", c("debt_pat"))
    has_de = c("de").isNotNull()
    return {
        "sales_growth": of("sales_growth", c("growth_used")),
        "cap_eff": of("cap_eff", F.coalesce("roce", "roe")),
        "valuation": (F.when(c("loss_making"), F.lit(0)).otherwise(valuation), weight),
        "balance": (F.when(has_de, de).otherwise(dpat), F.when(has_de, de_weight).otherwise(dpat_weight)),
        "promoter": of("promoter", c("promoter")),
        "size": of("size", c("mcap")),
        "momentum": of("momentum", F.coalesce("profit3y", "profit1y")),
    }


def scored(rows: DataFrame) -> DataFrame:
    """Add factor scores s_*, the weighted score over known factors, coverage, flags, verdict and entry zone.

    `theme` and `niche`, where the rows carry them, are judgement scores that add their weights.
    """
    full = derived(rows)
    factors = factor_scores()
    manual = {k: (F.col(k), F.lit(w)) for k, w in config.MANUAL_WEIGHTS.items() if k in rows.columns}
    full = full.withColumns({f"s_{k}": s for k, (s, _) in (factors | manual).items()} | {f"__w_{k}": w for k, (_, w) in (factors | manual).items()})

    def total(names: list[str], value) -> Column:
        return sum((F.when(F.col(f"s_{k}").isNotNull(), value(k)).otherwise(0.0) for k in names), F.lit(0.0))

    names = [*factors, *manual]
    have = total(names, lambda k: F.col(f"__w_{k}"))
    points = total(names, lambda k: F.col(f"__w_{k}") * F.col(f"s_{k}"))
    # A judgement weight counts only where a judgement exists; factor weights always count.
    every = sum((F.col(f"__w_{k}") for k in factors), F.lit(0.0)) + total(list(manual), lambda k: F.col(f"__w_{k}"))
    full = full.withColumns({"score": F.when(have > 0, points / have * 20), "coverage": have / every})
    return full.withColumn("flags", red_flags()).withColumns({"verdict": verdict(), "entry": entry_zone()}).drop(
        *[f"__w_{k}" for k in names]
    )


def red_flags() -> Column:
    return F.concat_ws("; ", *[F.when(F.expr(test), flag) for flag, test in config.RED_FLAGS])


def verdict() -> Column:
    c = F.col
    base = (
        F.when(c("score").isNull(), "")
        .when(c("promoter") < config.REJECT_PROMOTER_BELOW, "Reject: low promoter")
        .when(c("score") >= config.SHORTLIST_MIN, F.when(c("flags") == "", "Shortlist").otherwise("Shortlist - check flags"))
        .when(c("score") >= config.MAYBE_MIN, "Maybe")
        .otherwise("Skip")
    )
    thin = (base != "") & (c("coverage") < config.LOW_COVERAGE)
    return F.when(thin, F.concat(base, F.lit(" (low data)"))).otherwise(base)


def entry_zone() -> Column:
    return F.when(F.col("from_high").isNull(), "").when(
        F.col("from_high") <= config.DIP_ZONE, "dip zone"
    ).otherwise("near high: wait for dip/results")


def overlay(export: DataFrame, auto: DataFrame, auto_name: Column) -> DataFrame:
    """Export over automatic rows by `code`: export cells win where they hold text; `origin` says what was used."""
    e, a = export.alias("e"), auto.withColumn("__auto", auto_name).alias("a")
    joined = e.withColumn("__has_e", F.lit(True)).alias("e").join(a, F.col("e.code") == F.col("a.code"), "full_outer")
    has_e, source = F.col("e.__has_e").isNotNull(), F.col("a.__auto")
    origin = (
        F.when(has_e & source.isNotNull(), F.concat(F.lit("export + "), source)).when(has_e, "export").otherwise(source)
    )
    names = sorted((set(export.columns) | set(auto.columns)) - {"code"})

    def cell(name: str) -> Column:
        sides = [F.col(f"{s}.`{name}`").cast("string") for s, df in (("e", export), ("a", auto)) if name in df.columns]
        return text.first_filled(sides).alias(name)

    return joined.select(F.coalesce("e.code", "a.code").alias("code"), origin.alias("origin"), *[cell(n) for n in names])


def redacted(rows: DataFrame) -> DataFrame:
    """Public form: rows from a private source keep verdicts and failed labels, without figures."""
    private = F.col("private")
    hidden = {c: F.when(~private, F.col(c)) for c in ("pe", "roce", "promoter") if c in rows.columns}
    said = F.when(private, F.transform("fail_labels", lambda x: F.concat(x, F.lit(" fails")))).otherwise(F.col("fail_labels"))
    return rows.withColumns(hidden | {"fails": said})


def checked(rows: DataFrame) -> DataFrame:
    """One check per company: screen on bank-adjusted fields, score on score-adjusted ones. Needs `code` and `origin`."""
    base = bank_adjusted(rows)
    out = scored(bank_adjusted(screened(base), for_score=True))
    return out.withColumn("private", F.col("origin").contains("page"))


def ranked_universe(rows: DataFrame, key: str = "code") -> DataFrame:
    """Every company scored, screened with a derived P/E filled in, and ranked by score, unknown last."""
    # The screen reads the fields as exported; only an absent P/E is filled from the score.
    kept = rows.withColumns({f"__{c}": F.col(c) for c in ("debtor_days", "promoter")})
    restored = scored(bank_adjusted(kept, for_score=True)).withColumns(
        {"debtor_days": F.col("__debtor_days"), "promoter": F.col("__promoter"), "pe": F.coalesce("pe", round_binary(F.col("pe_used"), 1))}
    )
    full = screened(restored.drop("bank", "__debtor_days", "__promoter"))
    shown = full.withColumn("__shown", round_binary(F.col("score"), 1))
    return global_row_number(shown, [F.desc_nulls_last("__shown"), F.col(key)], "rank").drop("__shown")


def shortlist(ranked: DataFrame, clean: int = 8, flagged: int = 5) -> DataFrame:
    """The first clean and the first flagged companies by rank."""
    a = ranked.where(F.col("verdict") == "Shortlist").orderBy("rank").limit(clean)
    b = ranked.where(F.col("verdict").startswith("Shortlist - check")).orderBy("rank").limit(flagged)
    return a.unionByName(b)


def statement_ratios(wide: DataFrame) -> DataFrame:
    """Screen fields from newest-first yearly arrays.

    `wide`: code, revenue, net_income, ebit, assets, liabilities, debt, receivables, cash_flow,
    quarterly_income (arrays) and op_margin (share, may be NULL).
    """
    def at(name: str, k: int) -> Column:
        return F.get(name, F.lit(k))

    employed = at("assets", 0) - at("liabilities", 0)
    days0 = at("receivables", 0) / F.nullif(at("revenue", 0), F.lit(0.0)) * 365
    days1 = at("receivables", 1) / F.nullif(at("revenue", 1), F.lit(0.0)) * 365
    margin = F.coalesce("op_margin", at("ebit", 0) / F.nullif(at("revenue", 0), F.lit(0.0)))
    crore = 1e7
    raw = wide.select(
        "code",
        F.when(employed > 0, at("ebit", 0) / employed * 100).alias("roce"),
        cagr(F.col("revenue")).alias("sales3y"), cagr(F.col("net_income")).alias("profit3y"),
        growth(at("revenue", 0), at("revenue", 1)).alias("sales1y"),
        growth(at("net_income", 0), at("net_income", 1)).alias("profit1y"),
        growth(at("quarterly_income", 0), at("quarterly_income", 4)).alias("profit_q"),
        (at("net_income", 0) / crore).alias("pat"), (at("cash_flow", 0) / crore).alias("cfo"),
        (at("debt", 0) / crore).alias("debt"), ((at("debt", 0) - at("debt", 1)) / crore).alias("debt_change"),
        days0.alias("debtor_days"), days1.alias("__days1"), (margin * 100).alias("opm"),
    )
    once = with_rounded(raw, {c: 1 for c in raw.columns if c != "code"})
    changed = once.withColumn("debtor_days_ch", F.col("debtor_days") - F.col("__days1")).drop("__days1")
    return with_rounded(changed, {"debtor_days_ch": 1})

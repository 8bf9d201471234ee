"""Trading rules, score thresholds, horizons and word lists.

Everything here is a plain value that results depend on. Logic lives elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

# One rule row per scanner.
DAILY_WINDOW = 3
WEEKLY_WINDOW = 5
STOP_PCT = 15.0
MAX_HOLD = 250
COST_PCT = 0.25
EXIT_SPAN = 30
CONFIRM_DAYS = 10
STAKE = 100_000
SLOTS = 15
CAPITAL = 1_000_000.0
ALERT_DAYS = 4


@dataclass(frozen=True)
class Rule:
    """How signals of one scanner are traded; None means no limit."""

    weekly: bool = False
    window: int = DAILY_WINDOW
    stop_pct: float = STOP_PCT
    near_high: float | None = None
    atr_max: float | None = None
    max_hold: int = MAX_HOLD


DEFAULT_RULE = Rule()

LIVE_RULES: dict[str, Rule] = {
    "63_30_daily": Rule(near_high=10.0),
    "Bullish_Scanner": Rule(),
    "Wkly_upswing": Rule(weekly=True, window=WEEKLY_WINDOW, atr_max=4.0),
}

# Tiers and admission order.
TIER_ORDER = {"Midcap": 0, "Largecap": 1, "Smallcap": 2}
TIER_OTHER = 3
TIERS = ["Largecap", "Midcap", "Smallcap"]
LARGE_FROM = 100_000
MID_FROM = 30_000

CLOSED_STATUSES = ["target", "stop", "time", "average"]

# Holding horizons, label and sessions.
HORIZONS = [("2w", 10), ("1m", 21), ("3m", 63), ("6m", 126), ("1y", 252), ("2y", 504)]

# Model features, in order.
FEATURES_NUMERIC = [
    "ret_1d", "ret_5d", "ret_20d", "ret_60d",
    "dist_sma20", "dist_sma50", "dist_sma200",
    "rsi14", "atr_pct", "vol_ratio", "dist_52w_high", "log_turnover", "up_days_10",
    "bar_range_pct", "close_pos_in_bar", "trigger_gap_pct", "bar_risk_pct",
    "index_ret_20d", "index_dist_sma50",
]
REGULARISATION_C = 0.1
MIN_TRAIN = 300
FIRST_TEST_YEAR = 2020

# Local session clock.
LOCAL_ZONE = "+05:30"
OPEN_HHMM = "09:15"
CLOSE_HHMM = "15:30"
SLOT_MARKS = ["10:00", "13:00", "15:00"]
DAY_END = "20:00"

# Score factors as (weight, direction, thresholds).
FACTORS = {
    "sales_growth": (0.15, "higher", [5, 10, 15, 25, 40]),
    "cap_eff": (0.15, "higher", [8, 12, 16, 20, 30]),
    "valuation": (0.10, "lower", [3.0, 2.0, 1.5, 1.0, 0.7]),
    "balance_de": (0.10, "lower", [2.0, 1.0, 0.5, 0.25, 0.10]),
    "balance_dpat": (0.10, "lower", [5, 3, 2, 1, 0.5]),
    "promoter": (0.10, "higher", [30, 40, 50, 60, 70]),
    "size": (0.10, "lower", [50000, 10000, 3000, 1000, 500]),
    "momentum": (0.05, "higher", [0, 10, 20, 35, 50]),
}
MANUAL_WEIGHTS = {"theme": 0.15, "niche": 0.10}
SHORTLIST_MIN = 65
MAYBE_MIN = 50
LOW_COVERAGE = 0.70
REJECT_PROMOTER_BELOW = 30
DIP_ZONE = -20

# Export column names per logical field, first present and non-blank wins.
TEXT_FIELDS = {
    "name": ["Name"],
    "nse": ["NSE Code"],
    "bse": ["BSE Code"],
    "industry": ["Industry", "Industry Group"],
}
NUMBER_FIELDS = {
    "price": ["Current Price", "Current price"],
    "mcap": ["Market Capitalization"],
    "pe": ["Price to Earning"],
    "roce": ["Return on capital employed"],
    "roe": ["Return on equity"],
    "de": ["Debt to equity"],
    "promoter": ["Promoter holding"],
    "pledge": ["Pledged percentage"],
    "opm": ["OPM"],
    "sales3y": ["Sales growth 3Years"],
    "profit3y": ["Profit growth 3Years"],
    "sales1y": ["Sales growth"],
    "profit1y": ["Profit growth"],
    "profit_q": ["YOY Quarterly profit growth"],
    "pat": ["Profit after tax"],
    "cfo": ["CFO"],
    "debt": ["Debt"],
    "debt_change": ["Debt Change"],
    "debtor_days": ["Debtor days"],
    "debtor_days_ch": ["Debtor Days Ch"],
    "high": ["High price"],
}

MIN_CHECKED = 7

# The screen's rules as (label, what must be known, what must hold), and flags as (text, condition).
SCREEN_RULES = [
    ("Near 52w high", "price <> 0 AND high <> 0", "price / high * 100 > 80"),
    ("Market cap", "mcap IS NOT NULL", "mcap > 100 AND mcap < 5000"),
    ("ROCE", "roce IS NOT NULL", "roce > 15"),
    ("OPM", "opm IS NOT NULL", "opm > 5"),
    ("Debt/equity", "de IS NOT NULL", "de < 1.1"),
    ("Pledge", "pledge IS NOT NULL", "pledge = 0"),
    ("Promoter", "promoter IS NOT NULL", "promoter > 55"),
    ("Profit growth", "profit1y IS NOT NULL OR profit_q IS NOT NULL", "coalesce(profit1y > 40, false) OR coalesce(profit_q > 100, false)"),
    ("Debtor days", "debtor_days IS NOT NULL", "debtor_days < 150"),
    ("P/E", "pe IS NOT NULL", "pe > 0 AND pe < 20"),
]
RED_FLAGS = [
    ("weak cash conversion", "cfo_pat < 0.5"),
    ("negative CFO", "cfo < 0"),
    ("high debtor days", "debtor_days > 120"),
    ("debtor days rising", "debtor_days_ch > 20"),
    ("debt jumped", "debt > 0 AND debt_change > debt * 0.5"),
    ("one-off profit spike?", "profit1y > 500"),
]
UNCLASSIFIED = "Unclassified"

# Month names, of which the first three letters count too, and words that may stand inside a date.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
DATE_FILLERS = ["of", "st", "nd", "rd", "th"]

"""Per-scanner rule values as constant CASE expressions, so a lookup needs no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..config import Rule
from .numbers import round_binary


class RuleBook:
    """Column lookups over a small fixed dictionary of rules."""

    def __init__(self, rules: dict[str, Rule] | None = None, default: Rule = config.DEFAULT_RULE):
        self.rules = config.LIVE_RULES if rules is None else rules
        self.default = default

    def value(self, scanner: Column, field: str) -> Column:
        """The field's value for a scanner; unlisted scanners take the default rule."""
        fallback = F.lit(getattr(self.default, field))
        out = None
        for name, rule in self.rules.items():
            if getattr(rule, field) != getattr(self.default, field):
                hit = scanner == F.lit(name)
                value = F.lit(getattr(rule, field))
                out = F.when(hit, value) if out is None else out.when(hit, value)
        return fallback if out is None else out.otherwise(fallback)

    def weekly(self, scanner: Column) -> Column:
        return self.value(scanner, "weekly")

    def holds(self) -> list[int]:
        """Distinct holding limits in use."""
        return sorted({r.max_hold for r in [*self.rules.values(), self.default]})

    def longest_window(self) -> int:
        return max(r.window for r in [*self.rules.values(), self.default])

    def passes(self, scanner: Column, dist: Column, atr: Column) -> Column:
        """Entry filter; an unknown measure never rejects."""
        near = dist >= -self.value(scanner, "near_high").cast("double")
        calm = atr < self.value(scanner, "atr_max").cast("double")
        return F.coalesce(near, F.lit(True)) & F.coalesce(calm, F.lit(True))

    def skip_reason(self, scanner: Column, dist: Column, atr: Column) -> Column:
        """Why the filter rejected a signal."""
        limit = self.value(scanner, "near_high").cast("double")
        most = self.value(scanner, "atr_max").cast("double")
        far = F.concat(
            F.format_string("%.0f", round_binary(-dist, 0)), F.lit("% below its 52-week high (limit "),
            F.format_string("%.0f", limit), F.lit("%)"),
        )
        wild = F.concat(
            F.lit("too volatile: daily ATR "), F.format_string("%.1f", round_binary(atr, 1)), F.lit("% of price (limit "),
            F.format_string("%.0f", most), F.lit("%)"),
        )
        return F.when(dist < -limit, far).when(atr >= most, wild)


def tier_priority(tier: Column) -> Column:
    """Admission order of a size tier."""
    out = F.lit(config.TIER_OTHER)
    for name, rank in config.TIER_ORDER.items():
        out = F.when(tier == name, F.lit(rank)).otherwise(out)
    return out


def tier_from_size(mcap: Column) -> Column:
    """Size tier from market capitalisation in crore."""
    return F.when(mcap >= config.LARGE_FROM, "Largecap").when(mcap >= config.MID_FROM, "Midcap").when(
        mcap.isNotNull(), "Smallcap"
    )

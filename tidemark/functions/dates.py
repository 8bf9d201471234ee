"""Date parsing, local session days and Monday-to-Friday arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

# 1970-01-05 is the first Monday of the epoch.
_FIRST_MONDAY = "1970-01-05"


def day_month_year(c: Column) -> Column:
    """DATE from DD-MM-YYYY text."""
    return F.try_to_date(c, "dd-MM-yyyy")


def long_date(c: Column) -> Column:
    """DATE from text like `12 Nov 2026`; NULL when it does not parse."""
    return F.try_to_timestamp(c, F.lit("d MMM yyyy")).cast("date")


def local_time(ts: Column) -> Column:
    """Wall-clock time of a UTC timestamp in the market's fixed zone."""
    return F.from_utc_timestamp(ts, config.LOCAL_ZONE)


def session_date(ts: Column) -> Column:
    """Local calendar day; before the open it belongs to the day before."""
    local = local_time(ts)
    early = F.date_format(local, "HH:mm") < F.lit(config.OPEN_HHMM)
    return F.when(early, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))


def week_start(c: Column) -> Column:
    """Monday of the date's week."""
    return F.date_trunc("week", c).cast("date")


def weekday(c: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(c)


def _workdays_before(c: Column) -> Column:
    """Monday-to-Friday days between the first epoch Monday and c."""
    days = F.datediff(c, F.lit(_FIRST_MONDAY).cast("date"))
    return F.floor(days / 7).cast("int") * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def workdays_held(start: Column, end: Column) -> Column:
    """Monday-to-Friday days from start up to but not including end, plus one."""
    return (_workdays_before(end) - _workdays_before(start) + 1).cast("int")


def add_workdays(c: Column, n: int | Column) -> Column:
    """n Monday-to-Friday days later; a weekend counts from its Friday."""
    days = F.datediff(c, F.lit(_FIRST_MONDAY).cast("date"))
    total = F.floor(days / 7).cast("int") * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4)) + (n if isinstance(n, Column) else F.lit(n))
    offset = F.floor(total / 5).cast("int") * 7 + F.pmod(total, F.lit(5))
    return F.date_add(F.lit(_FIRST_MONDAY).cast("date"), offset)


def slot_of(local: Column) -> Column:
    """Scan slot of a local time, as `YYYY-MM-DD HH:MM`; NULL outside slots and on weekends."""
    clock = F.date_format(local, "HH:mm")
    marks = [*config.SLOT_MARKS, config.DAY_END]
    slot = F.lit(None).cast("string")
    for start, end in zip(marks, marks[1:]):
        slot = F.when((clock >= start) & (clock < end), F.lit(start)).otherwise(slot)
    stamp = F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" "), slot)
    return F.when((weekday(local) < 5) & slot.isNotNull(), stamp)


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600.0

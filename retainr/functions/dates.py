"""Date and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retainr.functions.columns import col


def _c(x) -> Column:
    return col(x) if isinstance(x, str) else x


def day_of(ts) -> Column:
    """``DATE(ts)`` / ``.dt.normalize()``."""
    return F.to_date(_c(ts))


def days_between(later, earlier) -> Column:
    """Whole calendar days ``DATEDIFF(later, earlier)`` as bigint."""
    return F.datediff(_c(later), _c(earlier)).cast("long")


def plus_days(ts, n) -> Column:
    """``ts + INTERVAL n DAY`` for timestamps."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.timestamp_add("DAY", n, _c(ts))


def minutes_between(start, end) -> Column:
    """Elapsed minutes ``(end - start).total_seconds() / 60`` as double (C17)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / 60_000_000.0


def elapsed_days_floor(later, earlier) -> Column:
    """Whole elapsed days between two timestamps, floored like ``Timedelta.days``."""
    micros = F.timestamp_diff("MICROSECOND", _c(earlier), _c(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def year_month(ts) -> Column:
    """``DATE_FORMAT(x, '%Y-%m')``."""
    return F.date_format(_c(ts), "yyyy-MM")


def month_start(ts) -> Column:
    """First day of the month, ``to_period('M').to_timestamp()`` as a date."""
    return F.trunc(F.to_date(_c(ts)), "MM")


def month_label(ts) -> Column:
    """``strftime('%b %Y')`` e.g. ``Jan 2025``."""
    return F.date_format(_c(ts), "MMM yyyy")


def monday_week_start(d) -> Column:
    """Monday of the ISO week containing ``d`` (intent of ``YEARWEEK(d, 1)``)."""
    return F.to_date(F.date_trunc("week", F.to_date(_c(d)).cast("timestamp_ntz")))


def week_start(d, mode: str = "monday") -> Column:
    """Week start of ``d`` (C08, trap T1).

    ``mode='monday'``: the Monday of the ISO week.
    ``mode='literal'``: what ``STR_TO_DATE(CONCAT(YEARWEEK(d,1),' Monday'), '%X%V %W')`` yields:
    the ISO week number re-read in Sunday-based numbering, i.e. the true Monday plus 7 days when
    1 January of the ISO year falls on Monday..Thursday, else the true Monday.
    """
    monday = monday_week_start(d)
    if mode == "monday":
        return monday
    if mode != "literal":
        raise ValueError(f"unknown week_start mode {mode!r}")
    iso_year = F.extract(F.lit("YEAROFWEEK"), F.to_date(_c(d)))
    jan1_dow = F.dayofweek(F.make_date(iso_year, F.lit(1), F.lit(1)))  # 1=Sunday..7=Saturday
    return F.date_add(monday, F.when(jan1_dow.between(2, 5), 7).otherwise(0))

"""Numeric and formatting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retainr.functions.columns import col


def _c(x) -> Column:
    return col(x) if isinstance(x, str) else x


def safe_ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)`` as double: NULL on a zero denominator (trap T8, SQL style)."""
    return F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0)))


def safe_divide(num, den) -> Column:
    """``safe_divide``: 0.0 on a zero denominator (helper style)."""
    return F.coalesce(safe_ratio(num, den), F.lit(0.0))


def round_double(x, digits: int) -> Column:
    """``ROUND(x, n)`` (half away from zero) returned as double."""
    return F.round(_c(x).cast("double"), digits)


def round_money(x, digits: int = 2) -> Column:
    """Round a decimal money expression in decimal arithmetic, then expose it as double."""
    return F.round(_c(x), digits).cast("double")


def clip(x, lower=None, upper=None) -> Column:
    """``clip(lower, upper)`` (C16); NULL stays NULL (``least``/``greatest`` alone would skip
    it and return a bound)."""
    out = _c(x)
    if upper is not None:
        out = F.least(out, F.lit(upper) if not isinstance(upper, Column) else upper)
    if lower is not None:
        out = F.greatest(out, F.lit(lower) if not isinstance(lower, Column) else lower)
    return F.when(_c(x).isNotNull(), out)


def thousands_text(x) -> Column:
    """Integer with blank thousands separators, ``f'{v:,}'.replace(',', ' ')`` (C20)."""
    return F.replace(F.format_number(_c(x).cast("long"), 0), F.lit(","), F.lit(" "))


def percent_text(x, digits: int = 2) -> Column:
    """A share as percent text, ``f'{v:.2%}'``: 0.1234 is ``12.34%`` (C20); NULL stays NULL."""
    share = _c(x).cast("double")
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share * 100))


def round_ratio(num, den, digits: int) -> Column:
    """``ROUND(num / den, digits)`` for integer-valued ``num``/``den`` with exact half-away-from-
    zero rounding (decimal semantics, no binary floating-point tie errors); NULL when den = 0.

    Quotient and remainder are taken first and only the remainder is scaled, all in 38-digit
    decimals, so sums far beyond 64 bits round exactly too.  Used for every rounded share or mean so
    that results are identical on any engine.
    """
    n, d = _c(num).cast("decimal(38,0)"), _c(den).cast("decimal(20,0)")
    size, unit = F.abs(n).cast("decimal(38,0)"), F.nullif(F.abs(d), F.lit(0).cast("decimal(20,0)"))
    rest = F.try_mod(size, unit).cast("decimal(20,0)")
    whole = ((size - rest) / unit).cast("decimal(28,0)")
    scale = F.lit(10 ** digits).cast("decimal(10,0)")
    twice = (2 * rest * scale + unit).cast("decimal(38,0)")
    part = F.call_function("div", twice, (2 * unit).cast("decimal(21,0)"))
    value = (whole + part.cast("decimal(28,8)") / scale).cast("double")
    return F.when((n < 0) != (d < 0), -value).otherwise(value)


def avg_round(x, digits: int, scale: int = 0) -> Column:
    """Aggregate: ``ROUND(AVG(x), digits)`` with exact decimal semantics.

    ``scale`` is the number of decimals ``x`` carries (0 for integers / 0-1 flags, 2 for money),
    so ``x * 10**scale`` is an exact integer; it is summed as a 28-digit decimal.
    """
    units = F.round(_c(x) * (10 ** scale)).cast("decimal(28,0)")
    return round_ratio(F.sum(units), F.count(_c(x)) * (10 ** scale), digits)

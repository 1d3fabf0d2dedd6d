"""Interval containment joins, on timestamps or dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

FAN = 32
LEVELS = 4
HOUR = 3_600_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def _bin(at: Column, width: Column) -> Column:
    """floor(at / width) of integers."""
    return F.call_function("div", at - F.pmod(at, width), width)


def interval_pieces(right: DataFrame, first: Column, last: Column, unit: int = HOUR) -> DataFrame:
    """One row for every time bin that touches [first, last] (microseconds, inclusive), with its ``__level`` and ``__bin``.

    Bins of level k are ``unit`` x ``FAN``**k long.  An interval takes the lowest level at which it touches at most
    ``FAN`` bins, so a long one is a few coarse bins: at most ``FAN`` rows an interval whatever its length (at the top level, one row
    for each 3.7 years with a unit of one hour)."""
    widths = [unit * FAN ** k for k in range(LEVELS)]
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        w = F.lit(widths[k])
        level = F.when(_bin(last, w) - _bin(first, w) < FAN, k).otherwise(level)
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), col("__level") + 1)
    return right.where(first <= last).withColumn("__level", level).withColumn("__width", width).withColumn(
        "__bin", F.explode(F.sequence(_bin(first, col("__width")), _bin(last, col("__width"))))).drop("__width")


def interval_join(left: DataFrame, time_col: str, right: DataFrame, start_col: str, end_col: str, how: str = "inner",
                  on: Sequence[str] = (), closed: str = "left", unit: int = HOUR) -> DataFrame:
    """Rows of ``left`` with every row of ``right`` that agrees in ``on`` and whose interval holds ``left[time_col]``.

    ``closed`` says which ends belong to an interval: "left" ``[start, end)``, "right" ``(start, end]``, "both" or
    "neither".  A null start or end is open; an interval that ends before it starts holds nothing; a null time is in none.
    ``how`` is "inner" or "left".  Columns of the two sides must have different names, but for ``on``.

    The join is an equi join on (``on``, level, bin): intervals become time bins (``interval_pieces``), and a left row looks up
    its bin at each level that occurs among the intervals (``LEVELS`` at most, mostly one).  A left row and an interval meet in exactly one
    bin, and the exact ends are a condition of the join.  Ends are cut to the times that occur on the left, so open and
    far-reaching intervals have no more bins than those.  AQE broadcasts the pieces when they are few and splits a hot bin otherwise.
    With "left", rows without an interval come from one anti join a level."""
    lower, upper = closed in ("left", "both"), closed in ("right", "both")
    seen = left.agg(F.struct(F.min(micros(col(time_col))).alias("lo"), F.max(micros(col(time_col))).alias("hi"))).scalar()
    right_only = [c for c in right.columns if c not in on]
    r = right.select(*[col(c).alias(f"__on_{c}") for c in on], *right_only).withColumns(
        {"__s": micros(col(start_col)), "__e": micros(col(end_col)), "__seen": seen})
    # the first and last microsecond inside
    r = r.withColumns({
        "__s": F.coalesce(col("__s") + (0 if lower else 1), col("__seen.lo")),
        "__e": F.coalesce(col("__e") - (0 if upper else 1), col("__seen.hi"))})
    pieces = interval_pieces(r, F.greatest(col("__s"), col("__seen.lo")), F.least(col("__e"), col("__seen.hi")), unit).drop("__seen")
    widths = F.array(*[F.lit(unit * FAN ** k) for k in range(LEVELS)])
    rows = left.withColumn("__t", micros(col(time_col)))

    def meets(level: Column | int) -> Column:
        cond = (col("__bin") == _bin(col("__t"), F.element_at(widths, level + 1 if isinstance(level, Column) else F.lit(level + 1))))
        for c in on:
            cond = cond & (left[c] == col(f"__on_{c}"))
        return cond & (col("__t") >= col("__s")) & (col("__t") <= col("__e"))

    used = pieces.agg(F.sort_array(F.collect_set("__level"))).scalar()
    at_levels = rows.withColumn("__at", F.explode(used))
    out = [*left.columns, *right_only]
    inner = at_levels.join(pieces, (col("__at") == col("__level")) & meets(col("__at"))).select(*[left[c] for c in left.columns], *right_only)
    if how == "inner":
        return inner
    alone = rows
    for k in range(LEVELS):
        alone = alone.join(pieces.where(col("__level") == k).drop(*right_only), meets(k), "left_anti")
    missing = {f.name: f.dataType for f in right.schema.fields}
    return inner.unionByName(alone.select(
        *left.columns, *[F.lit(None).cast(missing[c]).alias(c) for c in right_only])).select(*out)


def date_range_join(left: DataFrame, date_col: str, right: DataFrame, start_col: str,
                    end_col: str, how: str = "left") -> DataFrame:
    """Rows of ``left`` joined to every ``right`` row whose ``[start, end]`` (dates, inclusive) holds ``left[date_col]``."""
    return interval_join(left, date_col, right, start_col, end_col, how, closed="both", unit=24 * HOUR)

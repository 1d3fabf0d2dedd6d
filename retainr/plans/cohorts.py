"""Cohort retention and repeat-purchase analyses (Q01, Q02, Q03, Q17, Q18, Q21).

All of them start from ``user_days`` (one row per delivered user-day), so the fact table is
shuffled once, after map-side de-duplication, and every later step works on per-user or
per-cohort rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.functions.dates import month_label, month_start, plus_days, year_month
from retainr.functions.numeric import round_double, thousands_text
from retainr.plans.common import max_delivered_ts, user_days

MILESTONE_DAYS = (1, 7, 14, 30, 60)
REPEAT_HORIZONS = (7, 14, 30)


def cohort_retention_daily(orders: DataFrame, max_day: int = 90,
                           smoothing_rows: int = 3) -> DataFrame:
    """Q01: retained users per (first-order date, day 0..max_day) with a moving average.

    ``smoothed_retention_pct`` averages the unrounded percentages of the current and the
    ``smoothing_rows`` previous *present* cohorts at the same day (trap T4: cohorts without a
    retained user have no row and are skipped).
    """
    daily = (
        user_days(orders)
        .where(col("cohort_day").between(0, max_day))
        .groupBy("cohort_date", "cohort_day")
        .agg(F.count(F.lit(1)).alias("retained_users"))
    )
    # Day 0 of a cohort holds every member once, so its count is the cohort size.
    by_cohort = Window.partitionBy("cohort_date")
    size = F.max(F.when(col("cohort_day") == 0, col("retained_users"))).over(by_cohort)
    pct = 100.0 * col("retained_users").cast("double") / col("cohort_size")
    smooth = (Window.partitionBy("cohort_day").orderBy("cohort_date")
              .rowsBetween(-smoothing_rows, Window.currentRow))
    return (
        daily.withColumn("cohort_size", size)
        .withColumn("_pct", pct)
        .select(
            "cohort_date", "cohort_day", "cohort_size", "retained_users",
            round_double(col("_pct"), 2).alias("retention_pct"),
            round_double(F.avg("_pct").over(smooth), 2).alias("smoothed_retention_pct"),
        )
        .orderBy("cohort_date", "cohort_day")
    )


def cohort_milestone_pivot(orders: DataFrame, days=MILESTONE_DAYS) -> DataFrame:
    """Q02: exact-day retention at D1/D7/D14/D30/D60 per cohort (trap T5: exact day, no cap).

    One aggregate with conditional counts over de-duplicated user-days; no Expand of five
    distinct aggregates.
    """
    ud = user_days(orders)
    size = F.count_if(col("cohort_day") == 0)
    cols = [size.alias("users_in_cohort")]
    for d in days:
        cols.append(
            round_double(100.0 * F.count_if(col("cohort_day") == d).cast("double") / size, 2)
            .alias(f"d{d}_retention_pct"))
    return ud.groupBy("cohort_date").agg(*cols).orderBy("cohort_date")


def _per_user_repeat(orders: DataFrame, window_days: int = 30) -> DataFrame:
    """Per user: first delivered order and the repeat flags of Q03 and Q17/Q18.

    * ``interval_repeat`` (Q03): another delivered order in ``(first, first + w days]``.
      Same day: a later timestamp exists; days 1..w-1: always inside; day w: the earliest order
      of that day is not after ``first + w days``; later days never are.
    * ``min_repeat_day`` (Q17/Q18): smallest calendar-day gap >= 1 to a later order.
    """
    if window_days < 1:
        raise ValueError("window_days must be at least 1")
    ud = user_days(orders)
    day = col("cohort_day")
    in_interval = (
        ((day == 0) & (col("day_max_ts") > col("first_order_ts")))
        | day.between(1, window_days - 1)
        | ((day == window_days)
           & (col("day_min_ts") <= plus_days("first_order_ts", window_days)))
    )
    return ud.groupBy("user_id").agg(
        F.min("first_order_ts").alias("first_order_ts"),
        F.max(in_interval.cast("int")).alias("interval_repeat"),
        F.min(F.when(day >= 1, day)).alias("min_repeat_day"),
    )


def repeat_rate_30d_by_month(orders: DataFrame, window_days: int = 30) -> DataFrame:
    """Q03 (main product metric): share of users with a repeat delivered order within
    ``(first, first + 30 days]``, by month of the first order; only users whose first order
    is at least 30 days before the last delivered order."""
    anchor = max_delivered_ts(orders)
    users = (
        _per_user_repeat(orders, window_days)
        .where(col("first_order_ts") <= plus_days(anchor, -window_days))
    )
    base = F.count(F.lit(1))
    rep = F.sum("interval_repeat").cast("long")
    return (
        users.groupBy(year_month("first_order_ts").alias("cohort_month"))
        .agg(base.alias("users_base"), rep.alias("repeat_users_30d"))
        .withColumn("repeat_order_rate_30d_pct",
                    round_double(100.0 * col("repeat_users_30d") / col("users_base"), 2))
        .orderBy("cohort_month")
    )


def repeat_rate_by_window(orders: DataFrame, horizons=REPEAT_HORIZONS) -> DataFrame:
    """Q17: for h in 7/14/30, users with first order >= h days before the last delivered order
    and the share of them with a later order on calendar day 1..h (trap T6)."""
    anchor = max_delivered_ts(orders)
    users = _per_user_repeat(orders)
    aggs = []
    for h in horizons:
        eligible = col("first_order_ts") <= plus_days(anchor, -h)
        aggs.append(F.count_if(eligible).alias(f"b{h}"))
        aggs.append(F.count_if(eligible & (col("min_repeat_day") <= h)).alias(f"r{h}"))
    one_row = users.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(h).cast("long").alias("window_days"),
                 col(f"b{h}").alias("users_base"), col(f"r{h}").alias("repeat_users"))
        for h in horizons]))
    return (
        one_row.select(stacked.alias("s")).select("s.*")
        .withColumn("repeat_rate_pct",
                    F.coalesce(col("repeat_users").cast("double") / F.nullif(col("users_base"), F.lit(0)) * 100,
                               F.lit(0.0)))
    )


def _eligible_calendar_30(orders: DataFrame, window_days: int = 30) -> DataFrame:
    anchor = max_delivered_ts(orders)
    return (
        _per_user_repeat(orders)
        .where(col("first_order_ts") <= plus_days(anchor, -window_days))
        .withColumn("has_repeat", F.coalesce(col("min_repeat_day") <= window_days, F.lit(False)))
    )


def repeat_rate_30d_by_month_calendar(orders: DataFrame, window_days: int = 30) -> DataFrame:
    """Q18: calendar-day variant of Q03 per cohort month, unrounded percentage and a
    ``Mon YYYY`` label."""
    return (
        _eligible_calendar_30(orders, window_days)
        .groupBy(month_start("first_order_ts").alias("cohort_month"))
        .agg(F.count(F.lit(1)).alias("users_base"),
             F.count_if("has_repeat").alias("repeat_users"))
        .withColumn("repeat_rate_pct",
                    col("repeat_users").cast("double") / col("users_base") * 100)
        .withColumn("cohort_label", month_label("cohort_month"))
        .orderBy("cohort_month")
    )


def repeat_rate_30d_summary(orders: DataFrame, window_days: int = 30) -> DataFrame:
    """Q21: one row over the Q18 base: overall rate, repeat users, users base (+ display text)."""
    one = _eligible_calendar_30(orders, window_days).agg(
        F.count_if("has_repeat").alias("repeat_users"),
        F.count(F.lit(1)).alias("users_base"),
    )
    rate = col("repeat_users").cast("double") / F.nullif(col("users_base"), F.lit(0)) * 100
    return one.select(
        rate.alias("repeat_rate_pct"), "repeat_users", "users_base",
        F.format_string("%.1f%%", rate).alias("repeat_rate_text"),
        thousands_text("repeat_users").alias("repeat_users_text"),
        thousands_text("users_base").alias("users_base_text"),
    )


__all__ = ["cohort_retention_daily", "cohort_milestone_pivot", "repeat_rate_30d_by_month",
           "repeat_rate_by_window", "repeat_rate_30d_by_month_calendar",
           "repeat_rate_30d_summary"]

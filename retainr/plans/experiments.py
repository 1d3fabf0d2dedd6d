"""A/B test read-out (Q06-Q09).

``conversions`` is shared: exposures of one test, each flagged when the user has a delivered
order in ``[assigned_at, assigned_at + days)`` (trap T23: half-open).

Scale notes: orders are first cut to the test's time span (first assignment .. last
assignment + 7 days, two scalar subqueries) and reduced to one row per (user, day) with the
day's first and last order time, so a user owning a large share of the orders reaches the join
as at most one row per day; the window test is exact on those day rows.  The per-exposure
flag is then a distinct on (user, variant) and a left join of one-row-per-user relations.  Control and treatment are put
side by side by one conditional aggregate (no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.functions.numeric import round_ratio
from retainr.plans.common import delivered

TEST_ID = "free_delivery_banner_v1"
CONVERSION_DAYS = 7
ORDERS_PER_CONVERTED_USER = 1.8
MONTHS_PER_YEAR = 12
Z_CRITICAL_95 = 1.96


def exposures(assignments: DataFrame, test_id: str = TEST_ID) -> DataFrame:
    return (assignments.where(col("test_id") == test_id)
            .select("user_id", "variant", "assigned_at"))


def conversions(assignments: DataFrame, orders: DataFrame, test_id: str = TEST_ID,
                days: int = CONVERSION_DAYS) -> DataFrame:
    """One row per exposed (user_id, variant) with ``converted`` 0/1."""
    exp = exposures(assignments, test_id)
    # Only orders inside [first assignment, last assignment + days) can convert anyone: prune
    # the order side before it is shuffled (a test lasts weeks, the order history years).
    lo = exp.select(F.min("assigned_at")).scalar()
    hi = exp.select(F.max("assigned_at")).scalar()
    # One row per (user, day) with the day's first and last order time: partial aggregation
    # collapses a very active user to at most one row per day of the test span before the join.
    user_days = (
        delivered(orders)
        .where((col("order_ts") >= lo) & (col("order_ts") < F.timestamp_add("DAY", F.lit(days), hi)))
        .groupBy(col("user_id").alias("o_user"), F.to_date("order_ts").alias("d"))
        .agg(F.min("order_ts").alias("min_ts"), F.max("order_ts").alias("max_ts"))
    )
    end = F.timestamp_add("DAY", F.lit(days), col("assigned_at"))
    first_day, last_day = F.to_date("assigned_at"), F.to_date(end)
    # [a, a + days) on day d: first day needs an order at/after a, last day one before the end,
    # days in between any order.
    hit_cond = (
        (col("o_user") == col("user_id"))
        & col("d").between(first_day, last_day)
        & ((col("d") > first_day) | (col("max_ts") >= col("assigned_at")))
        & ((col("d") < last_day) | (col("min_ts") < end))
    )
    hit = (
        user_days.join(exp, hit_cond)
        .select("user_id", "variant").distinct()
        .withColumn("converted", F.lit(1))
    )
    return (
        exp.select("user_id", "variant").distinct()
        .join(hit, ["user_id", "variant"], "left")
        .select("user_id", "variant", F.coalesce("converted", F.lit(0)).alias("converted"))
    )


def ab_sample_ratio(assignments: DataFrame, test_id: str = TEST_ID) -> DataFrame:
    """Q06: assigned users per variant and share of all (2 dp); the guardrail is the share."""
    per_variant = (assignments.where(col("test_id") == test_id)
                   .groupBy("variant").agg(F.count(F.lit(1)).alias("assigned_users")))
    total = per_variant.select(F.sum("assigned_users")).scalar()  # SUM(COUNT(*)) OVER ()
    return per_variant.select(
        "variant", "assigned_users",
        round_ratio(100 * col("assigned_users"), total, 2).alias("share_pct"))


def _per_variant(conv: DataFrame) -> DataFrame:
    return conv.groupBy("variant").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum("converted").cast("long").alias("x"))


def ab_conversion_7d(assignments: DataFrame, orders: DataFrame, test_id: str = TEST_ID,
                     days: int = CONVERSION_DAYS) -> DataFrame:
    """Q07: per variant users, converted users, 7-day conversion (4 dp) and its percent
    (the rounded rate times 100, trap T10)."""
    agg = _per_variant(conversions(assignments, orders, test_id, days))
    rate4 = round_ratio(col("x"), col("n"), 4)
    return (
        agg.select(
            "variant", col("n").alias("users_n"), col("x").alias("converted_users_n"),
            rate4.alias("conversion_7d"),
            F.round(F.lit(100) * rate4, 2).alias("conversion_7d_pct"),
        )
        .orderBy("variant")
    )


def _control_treatment(assignments: DataFrame, orders: DataFrame, test_id: str,
                       days: int) -> DataFrame:
    """One row: n_c, x_c, p_c, n_t, x_t, p_t (empty when a variant is missing, trap T24)."""
    conv = conversions(assignments, orders, test_id, days)

    def of(variant: str, name: str):
        return F.when(col("variant") == variant, col(name))

    # control and treatment side by side: one conditional aggregate instead of a 1 x 1 join
    one = conv.agg(
        F.count(of("control", "converted")).alias("n_c"),
        F.sum(of("control", "converted")).cast("long").alias("x_c"),
        F.count(of("treatment", "converted")).alias("n_t"),
        F.sum(of("treatment", "converted")).cast("long").alias("x_t"))
    return (one.where((col("n_c") > 0) & (col("n_t") > 0))
            .withColumn("p_c", col("x_c").cast("double") / col("n_c"))
            .withColumn("p_t", col("x_t").cast("double") / col("n_t")))


def ab_ztest(assignments: DataFrame, orders: DataFrame, test_id: str = TEST_ID,
             days: int = CONVERSION_DAYS, z_critical: float = Z_CRITICAL_95) -> DataFrame:
    """Q08: two-proportion z-test; zero standard error gives NULL z, 'not_significant'."""
    ct = _control_treatment(assignments, orders, test_id, days)
    uplift = col("p_t") - col("p_c")
    pooled = (col("x_c") + col("x_t")).cast("double") / (col("n_c") + col("n_t"))
    se = F.sqrt(pooled * (1 - pooled) * (1.0 / col("n_c") + 1.0 / col("n_t")))
    z = F.try_divide(uplift, F.nullif(se, F.lit(0.0)))
    return ct.select(
        "n_c", "n_t", col("p_c").alias("control_rate"), col("p_t").alias("treatment_rate"),
        uplift.alias("absolute_uplift"), (100 * uplift).alias("uplift_pp"),
        pooled.alias("pooled_p"), z.alias("z_stat"),
        F.when(F.abs(z) >= z_critical, "significant_at_95").otherwise("not_significant")
        .alias("significance_95"),
    )


def ab_business_impact(assignments: DataFrame, orders: DataFrame, test_id: str = TEST_ID,
                       days: int = CONVERSION_DAYS,
                       orders_per_converted_user: float = ORDERS_PER_CONVERTED_USER) -> DataFrame:
    """Q09: uplift x treatment users x 1.8 orders x mean delivered margin, and x 12."""
    ct = _control_treatment(assignments, orders, test_id, days)
    avg_margin = (delivered(orders)
                  .select((F.sum("gross_margin_rub").cast("double") / F.count(F.lit(1))))
                  .scalar())
    uplift = col("p_t") - col("p_c")
    incr = uplift * col("n_t") * orders_per_converted_user * avg_margin
    return ct.select(
        F.round(100 * uplift, 2).alias("uplift_pp"),
        col("n_t").alias("treatment_users"),
        F.round(incr, 2).alias("incremental_gross_margin_rub_30d"),
        F.round(incr * MONTHS_PER_YEAR, 2).alias("projected_incremental_gross_margin_rub_annual"),
    )


__all__ = ["conversions", "ab_sample_ratio", "ab_conversion_7d", "ab_ztest",
           "ab_business_impact"]

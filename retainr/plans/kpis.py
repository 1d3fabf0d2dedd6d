"""Business KPIs (Q10-Q16).

Scale notes
* Per-day and per-week distinct users are two-level hash aggregates (partial aggregation on
  (day, user) before the shuffle), so one very active user never concentrates in a task.
* City and channel views aggregate orders per user *before* joining the user dimension
  (aggregate-before-join): the join sees one row per user on both sides, which removes the
  skew of the fact table from the join and shrinks its shuffle.
* The revenue-at-risk top-N is a ``TakeOrderedAndProject`` (per-partition top-N, then merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.functions.dates import week_start, year_month
from retainr.functions.numeric import avg_round, round_money, round_ratio
from retainr.plans.common import delivered, max_delivered_date, revenue

ON_TIME_MINUTES = 35
INACTIVE_DAYS = 28
AT_RISK_LIMIT = 500


def daily_kpis(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Q10: per session date DAU, sessions, delivered orders, buyers, buyers/DAU, AOV, GMV,
    margin.  Days with sessions but no orders get zeros; order-only days vanish (trap T12)."""
    s = (
        sessions.groupBy(F.to_date("session_start_ts").alias("dt"))
        .agg(F.count_distinct("user_id").alias("dau"), F.count(F.lit(1)).alias("sessions_n"))
    )
    o = (
        delivered(orders).groupBy(F.to_date("order_ts").alias("dt"))
        .agg(F.count(F.lit(1)).alias("delivered_orders_n"),
             F.count_distinct("user_id").alias("buyers_n"),
             round_money(F.sum(revenue())).alias("gmv_rub"),
             round_money(F.sum("gross_margin_rub")).alias("gross_margin_rub"),
             avg_round("basket_value_rub", 2, scale=2).alias("aov_rub"))
    )
    buyers = F.coalesce(col("buyers_n"), F.lit(0))
    return (
        s.join(o, "dt", "left")
        .select(
            "dt", "dau", "sessions_n",
            F.coalesce("delivered_orders_n", F.lit(0)).alias("delivered_orders_n"),
            buyers.alias("buyers_n"),
            round_ratio(buyers, col("dau"), 4).alias("buyer_conversion_from_dau"),
            F.coalesce("aov_rub", F.lit(0.0)).alias("aov_rub"),
            F.coalesce("gmv_rub", F.lit(0.0)).alias("gmv_rub"),
            F.coalesce("gross_margin_rub", F.lit(0.0)).alias("gross_margin_rub"),
        )
        .orderBy("dt")
    )


def wau_mau_stickiness(sessions: DataFrame, week_mode: str = "literal") -> DataFrame:
    """Q11: distinct users per week and per month, WAU/MAU with the month of the week start.

    ``week_mode='literal'`` reproduces the week-start dates of the relational original
    (trap T1); ``'monday'`` uses the true ISO Monday.  Inner join: weeks whose start month has
    no MAU drop out (trap T12).
    """
    day = F.to_date("session_start_ts")
    wau = (
        sessions.groupBy(week_start(day, week_mode).alias("week_start"))
        .agg(F.count_distinct("user_id").alias("wau"))
        .withColumn("ym", year_month("week_start"))
    )
    mau = sessions.groupBy(year_month(day).alias("ym")).agg(F.count_distinct("user_id").alias("mau"))
    return (
        wau.join(mau, "ym")
        .select("week_start", "wau", "ym", "mau",
                round_ratio(col("wau"), col("mau"), 4).alias("stickiness_wau_mau"))
        .orderBy("week_start")
    )


def repeat_rate_by_channel(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Q12: per acquisition channel: users, share with >= 2 delivered orders, mean orders;
    users without orders count in the denominator (trap T25)."""
    per_user = delivered(orders).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(col("n"), F.lit(0))
    return (
        users.select("user_id", "acquisition_channel")
        .join(per_user, "user_id", "left")
        .groupBy("acquisition_channel")
        .agg(F.count(F.lit(1)).alias("users_n"),
             avg_round(F.when(n >= 2, 1).otherwise(0), 4).alias("repeat_purchase_rate"),
             avg_round(n, 2).alias("avg_orders_per_user"))
        .orderBy(F.desc("repeat_purchase_rate"))
    )


def city_profit_sla(users: DataFrame, orders: DataFrame,
                    on_time_minutes: int = ON_TIME_MINUTES) -> DataFrame:
    """Q13: per *customer* city (trap T13): delivered orders, mean minutes, on-time share,
    total and mean margin.  Orders are reduced to one row per user before the join."""
    per_user = (
        delivered(orders).groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"),
             F.sum("delivery_minutes").alias("minutes"),
             F.count_if(col("delivery_minutes") <= on_time_minutes).alias("on_time"),
             F.sum("gross_margin_rub").alias("margin"))
    )
    by_city = (
        per_user.join(users.select("user_id", "city"), "user_id")
        .groupBy("city")
        .agg(F.sum("n").alias("delivered_orders_n"), F.sum("minutes").alias("minutes"),
             F.sum("on_time").alias("on_time"), F.sum("margin").alias("margin"))
    )
    n = col("delivered_orders_n")
    return (
        by_city.select(
            "city", n.cast("long").alias("delivered_orders_n"),
            round_ratio(col("minutes"), n, 2).alias("avg_delivery_minutes"),
            round_ratio(col("on_time"), n, 4).alias("on_time_share"),
            round_money(col("margin")).alias("total_margin_rub"),
            round_ratio((col("margin") * 100).cast("long"), n * 100, 2)
            .alias("margin_per_order_rub"),
        )
        .orderBy(F.desc("total_margin_rub"))
    )


def revenue_at_risk(orders: DataFrame, inactive_days: int = INACTIVE_DAYS,
                    limit: int = AT_RISK_LIMIT) -> DataFrame:
    """Q14: users idle for >= 28 days before the last delivered date, top 500 by historical
    margin, then idle days, then user_id (deterministic tie-break, trap T14)."""
    anchor = max_delivered_date(orders)
    per_user = (
        delivered(orders).groupBy("user_id")
        .agg(F.max(F.to_date("order_ts")).alias("last_order_date"),
             F.sum("gross_margin_rub").alias("margin"),
             F.count(F.lit(1)).alias("delivered_orders_n"))
        .withColumn("days_inactive", F.datediff(anchor, col("last_order_date")).cast("long"))
    )
    return (
        per_user.where(col("days_inactive") >= inactive_days)
        .orderBy(F.desc("margin"), F.desc("days_inactive"), F.asc("user_id"))
        .limit(limit)
        .select("user_id", "days_inactive", round_money(col("margin")).alias("total_margin_rub"),
                "delivered_orders_n")
    )


def eda_overview(users: DataFrame, orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q15: row counts of users, orders, sessions and the delivered share (4 dp)."""
    o = orders.agg(F.count(F.lit(1)).alias("orders_n"),
                   F.count_if(col("order_status") == "delivered").alias("delivered_n"))
    users_n = users.select(F.count(F.lit(1))).scalar()
    sessions_n = sessions.select(F.count(F.lit(1))).scalar()
    return o.select(users_n.alias("users_n"), "orders_n", sessions_n.alias("sessions_n"),
                    round_ratio(col("delivered_n"), col("orders_n"), 4).alias("delivered_share"))


def daily_orders_gmv(orders: DataFrame) -> DataFrame:
    """Q16: delivered orders and revenue (unrounded) per order date."""
    return (
        delivered(orders).groupBy(F.to_date("order_ts").alias("order_date"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(revenue()).cast("double").alias("gmv"))
        .orderBy("order_date")
    )

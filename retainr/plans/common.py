"""Shared building blocks of the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainr.functions.columns import col

DELIVERED = "delivered"


def delivered(orders: DataFrame) -> DataFrame:
    """``order_status = 'delivered'`` (pushed into the Parquet scan by Catalyst)."""
    return orders.where(col("order_status") == DELIVERED)


def revenue() -> Column:
    """Order revenue ``basket + fee - discount`` in decimal arithmetic."""
    return col("basket_value_rub") + col("delivery_fee_rub") - col("discount_rub")


def max_delivered_ts(orders: DataFrame) -> Column:
    """Anchor: ``MAX(order_ts)`` of delivered orders as a scalar subquery.

    Evaluated once by Spark and inlined as a value, no join and no driver round trip.
    """
    return delivered(orders).select(F.max("order_ts")).scalar()


def max_delivered_date(orders: DataFrame) -> Column:
    return delivered(orders).select(F.max(F.to_date("order_ts"))).scalar()


def user_days(orders: DataFrame) -> DataFrame:
    """Delivered activity per (user, calendar day) with the user's first order.

    Columns: user_id, order_date, day_min_ts, day_max_ts, day_orders, first_order_ts,
    cohort_date, cohort_day.

    Plan: partial+final hash aggregate on (user_id, order_date) -> one row per user-day, then a
    window by user_id.  The window only sees de-duplicated user-days, so even a user holding a
    large share of all orders contributes at most one row per calendar day to a task.
    """
    per_day = (
        delivered(orders)
        .groupBy("user_id", F.to_date("order_ts").alias("order_date"))
        .agg(F.min("order_ts").alias("day_min_ts"), F.max("order_ts").alias("day_max_ts"),
             F.count(F.lit(1)).alias("day_orders"))
    )
    w = Window.partitionBy("user_id")
    first_ts = F.min("day_min_ts").over(w)
    return (
        per_day.withColumn("first_order_ts", first_ts)
        .withColumn("cohort_date", F.to_date("first_order_ts"))
        .withColumn("cohort_day", F.datediff("order_date", "cohort_date").cast("long"))
    )

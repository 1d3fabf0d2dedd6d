"""RFM scoring, segments and lifetime value (Q04, Q05, Q19, Q20).

The per-user metrics are one hash aggregate over delivered orders (partial aggregation before
the shuffle).  Scores need a *global* order over all users, but only the users at the ends of the
tiles: ``operators.ranking`` finds them in scalar subqueries (no single-partition window, no job before
the action), and a projection compares every user with them.  The subqueries reuse the aggregate's exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.functions.numeric import avg_round
from retainr.operators.ranking import ntile_end, quantile_bin_end, with_tiles
from retainr.plans.common import delivered, max_delivered_date, revenue

TILES = 5
LTV_MARGIN = 0.28
DAYS_PER_MONTH = 30.0

# Expected customer lifetime in months per segment; 3 for anything else.
LIFETIME_MONTHS = {
    "Champions": 14,
    "Loyal": 11,
    "Potential Loyalists": 9,
    "Promising": 6,
    "Needs Attention": 5,
    "At Risk High Value": 4,
    "Hibernating": 2,
}
DEFAULT_LIFETIME_MONTHS = 3


def _scored(metrics: DataFrame, end) -> DataFrame:
    """Add r_score (recency reversed), f_score, m_score; ties ordered by user_id (trap T2)."""
    cents = (col("monetary_rub") * 100).cast("long")
    tiled = with_tiles(metrics, {"r_score": col("recency_days"), "f_score": col("frequency_orders"), "m_score": cents},
                       col("user_id"), TILES, end)
    return tiled.withColumn("r_score", (F.lit(TILES + 1) - col("r_score")).cast("int"))


def _rfm_text(r: Column, f: Column, m: Column) -> Column:
    return F.concat(r.cast("string"), f.cast("string"), m.cast("string"))


# Score limits and names of the segments.
def _segment7() -> Column:
    r, f, m = col("r_score"), col("f_score"), col("m_score")
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 4) & (f >= 3), "Loyal")
            .when((r >= 4) & (f <= 2), "Promising")
            .when((r == 3) & (f >= 3), "Needs Attention")
            .when((r <= 2) & (f >= 4), "At Risk High Value")
            .when((r <= 2) & (f <= 2), "Hibernating")
            .otherwise("Potential Loyalists"))


def _segment3() -> Column:
    r, f, m = col("r_score"), col("f_score"), col("m_score")
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r <= 2) & (f <= 2), "Hibernating")
            .otherwise("Other"))


def _segment5() -> Column:
    r, f, m = col("r_score"), col("f_score"), col("m_score")
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Core Users")
            .when((r >= 4) & (f >= 3), "Active Loyal")
            .when((r <= 2) & (f >= 4), "High Value at Risk")
            .when((r <= 2) & (f <= 2), "Dormant")
            .otherwise("Growth Potential"))


def user_rfm_metrics(orders: DataFrame, full: bool = True) -> DataFrame:
    """Per user over delivered orders: recency to the last delivered date, frequency,
    monetary = sum of revenue (2 dp, decimal), and with ``full`` margin, AOV, active days."""
    anchor = max_delivered_date(orders)
    d = F.to_date("order_ts")
    aggs = [
        F.datediff(anchor, F.max(d)).cast("long").alias("recency_days"),
        F.count(F.lit(1)).alias("frequency_orders"),
        F.round(F.sum(revenue()), 2).alias("monetary_rub"),
    ]
    if full:
        aggs += [
            F.round(F.sum("gross_margin_rub"), 2).alias("gross_margin_rub"),
            avg_round("basket_value_rub", 2, scale=2).alias("avg_order_value_rub"),
            (F.datediff(F.max(d), F.min(d)) + 1).cast("long").alias("active_days"),
        ]
    return delivered(orders).groupBy("user_id").agg(*aggs)


def rfm_user_ltv(orders: DataFrame) -> DataFrame:
    """Q04: RFM scores (NTILE 5), 7-way segment, monthly revenue and predicted LTV per user."""
    s = _scored(user_rfm_metrics(orders, full=True), ntile_end)
    months = F.lit(DEFAULT_LIFETIME_MONTHS)
    seg = col("segment")
    for name, value in reversed(list(LIFETIME_MONTHS.items())):
        months = F.when(seg == name, value).otherwise(months)
    monthly = F.round(
        col("monetary_rub").cast("double")
        / F.greatest(col("active_days").cast("double") / DAYS_PER_MONTH, F.lit(1.0)), 2)
    return (
        s.withColumn("segment", _segment7())
        .withColumn("monthly_revenue_rub", monthly)
        .withColumn("expected_lifetime_months", months.cast("long"))
        .select(
            "user_id", "recency_days", "frequency_orders",
            col("monetary_rub").cast("double").alias("monetary_rub"),
            col("gross_margin_rub").cast("double").alias("gross_margin_rub"),
            "avg_order_value_rub", "segment",
            _rfm_text(col("r_score"), col("f_score"), col("m_score")).alias("rfm_score"),
            "monthly_revenue_rub", "expected_lifetime_months",
            F.round(col("monthly_revenue_rub") * col("expected_lifetime_months") * LTV_MARGIN, 2)
            .alias("predicted_ltv_rub"),
        )
        .orderBy(F.desc("predicted_ltv_rub"), "user_id")
    )


def rfm_segment_summary(orders: DataFrame) -> DataFrame:
    """Q05: Champions / Hibernating / Other: users and mean recency, frequency, monetary."""
    s = _scored(user_rfm_metrics(orders, full=False), ntile_end).withColumn("segment", _segment3())
    return (
        s.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("users_cnt"),
             avg_round("recency_days", 2).alias("avg_recency_days"),
             avg_round("frequency_orders", 2).alias("avg_frequency_orders"),
             avg_round("monetary_rub", 2, scale=2).alias("avg_monetary_rub"))
        .orderBy(F.desc("avg_monetary_rub"))
    )


def rfm_segments_calendar(orders: DataFrame) -> DataFrame:
    """Q19: RFM with monetary = sum of basket, equal-count bins of first-ranks (trap T3) and the
    5-way segment."""
    anchor = max_delivered_date(orders)
    metrics = (
        delivered(orders).groupBy("user_id")
        .agg(F.datediff(anchor, F.max(F.to_date("order_ts"))).cast("long").alias("recency_days"),
             F.count(F.lit(1)).alias("frequency_orders"),
             F.sum("basket_value_rub").alias("monetary_rub"))
    )
    s = _scored(metrics, quantile_bin_end)
    return s.select(
        "user_id", "recency_days", "frequency_orders",
        col("monetary_rub").cast("double").alias("monetary_rub"),
        "r_score", "f_score", "m_score",
        _rfm_text(col("r_score"), col("f_score"), col("m_score")).alias("rfm_score"),
        _segment5().alias("segment"),
    )


def rfm_segments_calendar_summary(orders: DataFrame) -> DataFrame:
    """Q20: users and mean monetary per 5-way segment, by mean monetary descending."""
    seg = rfm_segments_calendar(orders)
    return (
        seg.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("users"),
             (F.sum(col("monetary_rub").cast("decimal(22,2)")).cast("double")
              / F.count(F.lit(1))).alias("avg_monetary"))
        .orderBy(F.desc("avg_monetary"))
    )


__all__ = ["user_rfm_metrics", "rfm_user_ltv", "rfm_segment_summary", "rfm_segments_calendar",
           "rfm_segments_calendar_summary"]

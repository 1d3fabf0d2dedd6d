"""Tables that feed the reference's charts (V1-V6).  Rendering is out of scope; these are the
small result sets a plotting client would collect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.plans import cohorts, kpis, rfm


def repeat_rate_bars(orders: DataFrame) -> DataFrame:
    """V1: repeat rate per window with its ``xx.x%`` label."""
    return cohorts.repeat_rate_by_window(orders).withColumn(
        "label", F.format_string("%.1f%%", col("repeat_rate_pct")))


def rfm_bubble(orders: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """V2: recency, frequency, monetary, segment, score per user; optionally sampled so that
    only a bounded share reaches the plotting client."""
    out = rfm.rfm_user_ltv(orders).select("user_id", "recency_days", "frequency_orders",
                                          "monetary_rub", "segment", "rfm_score")
    return out.sample(fraction=fraction, seed=seed) if fraction else out


def metric_card(metrics: DataFrame) -> DataFrame:
    """V3: roc_auc, pr_auc, f1, recall at 3 decimals, missing -> 0."""
    cols = ["roc_auc", "pr_auc", "f1", "recall"]
    return metrics.select(*[
        F.round(F.coalesce(col(c).cast("double") if c in metrics.columns else F.lit(None).cast("double"),
                           F.lit(0.0)), 3).alias(c) for c in cols])


def top_importances(importances: DataFrame, top_n: int = 15) -> DataFrame:
    """V4: the top-n feature importances."""
    return importances.orderBy(F.desc("importance"), "feature").limit(top_n)


def daily_series(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """V5: daily delivered orders, GMV and DAU."""
    return kpis.daily_kpis(sessions, orders).select("dt", "delivered_orders_n", "gmv_rub", "dau")


def repeat_panels(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V6: repeat windows and monthly cohorts side by side."""
    return (cohorts.repeat_rate_by_window(orders),
            cohorts.repeat_rate_30d_by_month_calendar(orders))

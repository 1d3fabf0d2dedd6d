"""Named analyses over the canonical tables: ``QUERIES[name](tables) -> DataFrame``.

``tables`` is the dict returned by ``retainr.sources.mapping.canonical_tables`` (or any dict of
DataFrames with the canonical schemas, e.g. loaded with ``retainr.sources.tables.load_tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.plans import activity, churn, cohorts, experiments, features, kpis, quality, rfm
from retainr.plans.experiments import TEST_ID
from retainr.sources.mapping import SESSION_EVENTS

Tables = dict[str, DataFrame]


def _sessions(t: Tables) -> DataFrame:
    """Sessions for queries that do not name the user's city or device: without the join that looks them up, where the
    tables offer that."""
    return t[SESSION_EVENTS] if SESSION_EVENTS in t else t["fact_app_sessions"]


def _user_features(t: Tables) -> DataFrame:
    return features.user_features(t["dim_users"], t["fact_orders"], _sessions(t),
                                  t["fact_ab_test_assignments"], test_id=TEST_ID)


# Reference times of a model's training rows: the ends of two half-years and a quarter.
FEATURE_CUTS = ["1997-12-31 23:59:59", "1998-03-31 23:59:59", "2001-07-15 12:00:00"]


def _scores(t: Tables) -> DataFrame:
    return churn.recency_scores(_user_features(t))


def _churn_metrics(t: Tables) -> DataFrame:
    # at the best balanced-accuracy threshold; AUC and AP to 10 decimals (sums of doubles in a
    # different order differ in the last bits)
    m = churn.classification_metrics(_scores(t))
    return m.withColumns({c: F.round(c, 10) for c in ("roc_auc", "pr_auc")})


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # 2.11 cohorts
    "cohort_retention_daily": lambda t: cohorts.cohort_retention_daily(t["fact_orders"]),
    "cohort_milestone_pivot": lambda t: cohorts.cohort_milestone_pivot(t["fact_orders"]),
    "repeat_rate_30d_by_month": lambda t: cohorts.repeat_rate_30d_by_month(t["fact_orders"]),
    "repeat_rate_by_window": lambda t: cohorts.repeat_rate_by_window(t["fact_orders"]),
    "repeat_rate_30d_by_month_calendar":
        lambda t: cohorts.repeat_rate_30d_by_month_calendar(t["fact_orders"]),
    "repeat_rate_30d_summary": lambda t: cohorts.repeat_rate_30d_summary(t["fact_orders"]),
    # 2.12 features
    "order_features": lambda t: features.order_features(t["fact_orders"]),
    "session_features": lambda t: features.session_features(_sessions(t)),
    "ab_features": lambda t: features.ab_features(t["fact_ab_test_assignments"]),
    "user_features": lambda t: _user_features(t),
    "user_features_by_cut": lambda t: features.user_features_at(
        t["dim_users"], t["fact_orders"], _sessions(t), t["fact_ab_test_assignments"], FEATURE_CUTS, test_id=TEST_ID),
    "modeling_dataset": lambda t: features.modeling_dataset(_user_features(t)),
    # 2.15 data quality
    "check_constraints": lambda t: quality.check_constraints(t),
    "active_campaigns":
        lambda t: quality.active_campaigns(t["fact_orders"], t["dim_promo_campaigns"]),
    "reconcile_items": lambda t: quality.reconcile_items(t["fact_orders"], t["fact_order_items"]),
    "audit_margin": lambda t: quality.audit_margin(
        t["fact_orders"], quality.linear_margin(0.28, 9, -200, 1500), (-260, -20)),
    "link_sessions_orders":
        lambda t: quality.link_sessions_orders(_sessions(t), t["fact_orders"]),
    # 2.13 churn model: metrics and economics on a score derived from the feature table
    "churn_threshold": lambda t: churn.best_threshold(_scores(t)),
    "churn_metrics": lambda t: _churn_metrics(t),
    "campaign_economics": lambda t: churn.campaign_economics(_scores(t)),
    "top_k_precision": lambda t: churn.top_k_precision(_scores(t)),
    "winsorize_basket": lambda t: churn.winsorize(
        t["fact_orders"].select("order_id", "basket_value_rub"), "basket_value_rub",
        out_col="basket_value_rub_winsorized").drop("basket_value_rub"),
    "target_summary": lambda t: churn.target_summary(_user_features(t), "churn_label", "churn_label"),
    # 2.11 RFM
    "rfm_user_ltv": lambda t: rfm.rfm_user_ltv(t["fact_orders"]),
    "rfm_segment_summary": lambda t: rfm.rfm_segment_summary(t["fact_orders"]),
    "rfm_segments_calendar": lambda t: rfm.rfm_segments_calendar(t["fact_orders"]),
    "rfm_segments_calendar_summary": lambda t: rfm.rfm_segments_calendar_summary(t["fact_orders"]),
    # 2.11 experiments
    "ab_sample_ratio": lambda t: experiments.ab_sample_ratio(t["fact_ab_test_assignments"]),
    "ab_conversion_7d":
        lambda t: experiments.ab_conversion_7d(t["fact_ab_test_assignments"], t["fact_orders"]),
    "ab_ztest": lambda t: experiments.ab_ztest(t["fact_ab_test_assignments"], t["fact_orders"]),
    "ab_business_impact":
        lambda t: experiments.ab_business_impact(t["fact_ab_test_assignments"], t["fact_orders"]),
    # 2.11 KPIs
    "daily_kpis": lambda t: kpis.daily_kpis(_sessions(t), t["fact_orders"]),
    "wau_mau_stickiness": lambda t: kpis.wau_mau_stickiness(_sessions(t)),
    "wau_mau_from_daily_state":
        lambda t: activity.wau_mau_stickiness(activity.merge_days(activity.daily_users(_sessions(t)))),
    "repeat_rate_by_channel": lambda t: kpis.repeat_rate_by_channel(t["dim_users"], t["fact_orders"]),
    "city_profit_sla": lambda t: kpis.city_profit_sla(t["dim_users"], t["fact_orders"]),
    "revenue_at_risk": lambda t: kpis.revenue_at_risk(t["fact_orders"]),
    "eda_overview": lambda t: kpis.eda_overview(t["dim_users"], t["fact_orders"], _sessions(t)),
    "daily_orders_gmv": lambda t: kpis.daily_orders_gmv(t["fact_orders"]),
}


def _model_scores(t: Tables) -> DataFrame:
    # a few shallow trees: training runs a job a level
    result = churn.train_churn_model(features.eligible(_user_features(t)), maxIter=3, maxDepth=3)
    return result.scored_test.select("user_id", churn.TARGET, churn.SCORE)


# Queries that train a model first: split, category encoder, booster, scores of the test rows (M1-M4).
MODEL_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {"churn_model_scores": _model_scores}

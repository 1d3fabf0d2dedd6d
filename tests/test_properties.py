"""Invariants on the driver's sf0.01 tables."""

import pytest
from pyspark.sql import functions as F

from retainr.plans import cohorts, experiments, rfm
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def t(spark):
    return canonical_tables(spark, SF_ORACLE)


def test_day_zero_retention_is_full(t):
    q = cohorts.cohort_retention_daily(t["fact_orders"])
    assert q.where("cohort_day = 0 AND retention_pct <> 100.0").count() == 0
    assert q.where("retained_users > cohort_size").count() == 0


def test_repeaters_never_exceed_base(t):
    for q, rep in ((cohorts.repeat_rate_30d_by_month(t["fact_orders"]), "repeat_users_30d"),
                   (cohorts.repeat_rate_30d_by_month_calendar(t["fact_orders"]), "repeat_users"),
                   (cohorts.repeat_rate_by_window(t["fact_orders"]), "repeat_users")):
        assert q.where(F.col(rep) > F.col("users_base")).count() == 0


def test_variant_shares_sum_to_hundred(t):
    total = experiments.ab_sample_ratio(t["fact_ab_test_assignments"]).agg(F.sum("share_pct")).first()[0]
    assert abs(total - 100.0) <= 0.02


def test_rfm_tiles_balanced_and_segments_partition_users(t):
    ltv = rfm.rfm_user_ltv(t["fact_orders"]).cache()
    n = ltv.count()
    for i, name in enumerate(("r", "f", "m")):
        sizes = [r[1] for r in ltv.groupBy(F.substring("rfm_score", i + 1, 1)).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1, name
    summary = rfm.rfm_segment_summary(t["fact_orders"]).agg(F.sum("users_cnt")).first()[0]
    assert summary == n
    cal = rfm.rfm_segments_calendar_summary(t["fact_orders"]).agg(F.sum("users")).first()[0]
    assert cal == n

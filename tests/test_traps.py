"""Hand fixtures for the semantic traps, results worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from retainr.functions.dates import week_start
from retainr.plans import cohorts, experiments, features
from retainr.plans.experiments import TEST_ID
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_SMALL
from tests.fixtures import assignments, orders, sessions, users


def _repeat_orders(spark):
    return orders(spark, [
        # A: second order the same day -> interval repeat, not a calendar repeat
        dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00"),
        dict(order_id=2, user_id=1, order_ts="2025-01-01 12:00:00"),
        # B: calendar day 30, inside 30 x 24 h
        dict(order_id=3, user_id=2, order_ts="2025-01-01 10:00:00"),
        dict(order_id=4, user_id=2, order_ts="2025-01-31 09:00:00"),
        # C: calendar day 30, after 30 x 24 h
        dict(order_id=5, user_id=3, order_ts="2025-01-01 10:00:00"),
        dict(order_id=6, user_id=3, order_ts="2025-01-31 11:00:00"),
        # D: exactly +30 days (bound included)
        dict(order_id=7, user_id=4, order_ts="2025-01-02 10:00:00"),
        dict(order_id=8, user_id=4, order_ts="2025-02-01 10:00:00"),
        # E: two orders at one timestamp only, plus a cancelled one
        dict(order_id=9, user_id=5, order_ts="2025-01-03 10:00:00"),
        dict(order_id=10, user_id=5, order_ts="2025-01-03 10:00:00"),
        dict(order_id=11, user_id=5, order_ts="2025-01-04 10:00:00", order_status="cancelled"),
        # F: anchor; first order inside the immature last 30 days
        dict(order_id=12, user_id=6, order_ts="2025-03-15 08:00:00"),
    ])


def test_interval_vs_calendar_repeat(spark):
    o = _repeat_orders(spark)
    q03 = {r["cohort_month"]: r for r in cohorts.repeat_rate_30d_by_month(o).collect()}
    assert set(q03) == {"2025-01"}
    assert (q03["2025-01"]["users_base"], q03["2025-01"]["repeat_users_30d"]) == (5, 3)
    assert q03["2025-01"]["repeat_order_rate_30d_pct"] == 60.0
    q18 = cohorts.repeat_rate_30d_by_month_calendar(o).collect()
    assert [(r["users_base"], r["repeat_users"], r["cohort_label"]) for r in q18] == [(5, 3, "Jan 2025")]
    q21 = cohorts.repeat_rate_30d_summary(o).first()
    assert (q21["repeat_users"], q21["users_base"], q21["repeat_rate_text"]) == (3, 5, "60.0%")


def test_repeat_windows_zero_base(spark):
    o = orders(spark, [dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00")])
    rows = {r["window_days"]: r for r in cohorts.repeat_rate_by_window(o).collect()}
    assert rows[7]["users_base"] == 0 and rows[7]["repeat_rate_pct"] == 0.0


def test_milestones_are_exact_days(spark):
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00"),
        dict(order_id=2, user_id=1, order_ts="2025-01-08 10:00:00"),   # day 7
        dict(order_id=3, user_id=1, order_ts="2025-01-08 11:00:00"),   # day 7 again
        dict(order_id=4, user_id=2, order_ts="2025-01-01 10:00:00"),
        dict(order_id=5, user_id=2, order_ts="2025-01-09 10:00:00"),   # day 8: no milestone
    ])
    r = cohorts.cohort_milestone_pivot(o).first()
    assert r["users_in_cohort"] == 2
    assert (r["d1_retention_pct"], r["d7_retention_pct"], r["d14_retention_pct"]) == (0.0, 50.0, 0.0)


def test_smoothing_skips_missing_cohorts(spark):
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00"),
        dict(order_id=2, user_id=1, order_ts="2025-01-02 10:00:00"),
        dict(order_id=3, user_id=2, order_ts="2025-01-02 10:00:00"),   # cohort 01-02, no day 1
        dict(order_id=4, user_id=3, order_ts="2025-01-03 10:00:00"),
        dict(order_id=5, user_id=4, order_ts="2025-01-03 10:00:00"),
        dict(order_id=6, user_id=3, order_ts="2025-01-04 10:00:00"),   # cohort 01-03 day 1: 1/2
    ])
    rows = [r for r in cohorts.cohort_retention_daily(o).collect() if r["cohort_day"] == 1]
    assert [(str(r["cohort_date"]), r["retention_pct"], r["smoothed_retention_pct"]) for r in rows] == [
        ("2025-01-01", 100.0, 100.0), ("2025-01-03", 50.0, 75.0)]


def test_ab_window_is_half_open_and_zero_se(spark):
    a = assignments(spark, [
        dict(user_id=1, variant="control", assigned_at="2025-01-01 10:00:00"),
        dict(user_id=2, variant="control", assigned_at="2025-01-01 10:00:00"),
        dict(user_id=3, variant="treatment", assigned_at="2025-01-01 10:00:00"),
        dict(user_id=4, variant="treatment", assigned_at="2025-01-01 10:00:00"),
    ])
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00"),                 # at assignment: in
        dict(order_id=2, user_id=2, order_ts="2025-01-08 10:00:00"),                 # +7 d: out
        dict(order_id=3, user_id=3, order_ts="2025-01-02 10:00:00", order_status="cancelled"),
        dict(order_id=4, user_id=4, order_ts="2024-12-31 10:00:00"),                 # before: out
    ])
    conv = {r["variant"]: r for r in experiments.ab_conversion_7d(a, o).collect()}
    assert conv["control"]["converted_users_n"] == 1 and conv["treatment"]["converted_users_n"] == 0
    assert conv["control"]["conversion_7d"] == 0.5 and conv["control"]["conversion_7d_pct"] == 50.0
    z = experiments.ab_ztest(a, o).first()
    assert z["z_stat"] is not None and z["significance_95"] == "not_significant"
    none = orders(spark, [dict(order_id=9, user_id=9, order_ts="2025-01-01 00:00:00")])
    z0 = experiments.ab_ztest(a, none).first()
    assert z0["z_stat"] is None and z0["significance_95"] == "not_significant"
    only_control = a.where(F.col("variant") == "control")
    assert experiments.ab_ztest(only_control, o).count() == 0


def test_literal_week_start(spark):
    df = spark.createDataFrame([(date(2004, 10, 13),), (date(2021, 6, 9),), (date(2025, 3, 31),)], "d date")
    got = [r[0] for r in df.select(week_start(F.col("d"), "literal")).collect()]
    # documented example: '200442 Monday' with %X%V %W is 2004-10-18; 2021 starts on a Friday
    assert got == [date(2004, 10, 18), date(2021, 6, 7), date(2025, 4, 7)]
    mondays = [r[0] for r in df.select(week_start(F.col("d"), "monday")).collect()]
    assert mondays == [date(2004, 10, 11), date(2021, 6, 7), date(2025, 3, 31)]


def test_features_do_not_leak_future_rows(spark):
    t = canonical_tables(spark, SF_SMALL)
    ref = "2001-06-01 00:00:00"
    base = features.user_features(t["dim_users"], t["fact_orders"], t["fact_app_sessions"],
                                  t["fact_ab_test_assignments"], reference_date=ref, test_id=TEST_ID)
    extra = orders(spark, [dict(order_id=10**9, user_id=1, order_ts="2001-06-05 00:00:00",
                                basket="999.00")])
    more = t["fact_orders"].unionByName(extra)
    changed = features.user_features(t["dim_users"], more, t["fact_app_sessions"],
                                     t["fact_ab_test_assignments"], reference_date=ref, test_id=TEST_ID)
    cols = [c for c in base.columns if c not in ("future_orders_cnt", "churn_label")]
    assert base.select(cols).exceptAll(changed.select(cols)).count() == 0
    f_before = base.where("user_id = 1").first()["future_orders_cnt"]
    f_after = changed.where("user_id = 1").first()["future_orders_cnt"]
    assert f_after == f_before + 1


def test_features_use_one_test_and_reject_double_assignment(spark):
    u = users(spark, [1, 2])
    o = orders(spark, [dict(order_id=1, user_id=1, order_ts="2025-03-01 10:00:00")])
    s = sessions(spark, [dict(session_id=1, user_id=1, start="2025-01-02 10:00:00")])
    two = [dict(user_id=1, variant="treatment", assigned_at="2025-01-01 00:00:00"),
           dict(user_id=1, variant="control", assigned_at="2025-01-01 00:00:00", test_id="another")]
    got = features.user_features(u, o, s, assignments(spark, two), test_id=TEST_ID).collect()
    assert sorted((r["user_id"], r["variant"]) for r in got) == [(1, "treatment"), (2, None)]
    again = two + [dict(user_id=1, variant="control", assigned_at="2025-01-02 00:00:00")]
    with pytest.raises(Exception, match="more than one assignment"):
        features.user_features(u, o, s, assignments(spark, again), test_id=TEST_ID).collect()


def test_conversion_window_day_boundaries(spark):
    a = assignments(spark, [dict(user_id=u, variant="control", assigned_at="2025-01-01 10:00:00")
                            for u in range(1, 6)])
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-01 09:59:59"),   # same day, before: out
        dict(order_id=2, user_id=2, order_ts="2025-01-01 09:00:00"),   # same day, before ...
        dict(order_id=3, user_id=2, order_ts="2025-01-01 11:00:00"),   # ... and after: in
        dict(order_id=4, user_id=3, order_ts="2025-01-08 09:59:59"),   # last second: in
        dict(order_id=5, user_id=4, order_ts="2025-01-08 10:00:00"),   # end, excluded: out
        dict(order_id=6, user_id=5, order_ts="2025-01-04 00:00:00"),   # a middle day: in
    ])
    got = {r["user_id"]: r["converted"] for r in experiments.conversions(a, o).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_interval_repeat_other_windows(spark):
    o = _repeat_orders(spark)
    # 7-day window: the same five January users are eligible (F's first order is the anchor
    # itself); a repeat within (first, first + 7 d] exists only for A (same day).
    got = {r["cohort_month"]: (r["users_base"], r["repeat_users_30d"])
           for r in cohorts.repeat_rate_30d_by_month(o, window_days=7).collect()}
    assert got == {"2025-01": (5, 1)}
    got1 = {r["cohort_month"]: r["repeat_users_30d"]
            for r in cohorts.repeat_rate_30d_by_month(o, window_days=1).collect()}
    assert got1 == {"2025-01": 1}

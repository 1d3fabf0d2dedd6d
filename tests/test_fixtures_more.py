"""More hand fixtures (FIXTURES.md part B): KPIs, channels, inactivity, campaigns, constraints."""

from pyspark.sql import functions as F

from retainr.operators import joins
from retainr.plans import kpis, quality
from retainr.sources.schemas import SCHEMAS
from tests.fixtures import campaigns, orders, sessions, users


def test_revenue_at_risk_edges(spark):
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-03-01 10:00:00", margin="50.00"),   # 28 idle
        dict(order_id=2, user_id=2, order_ts="2025-03-02 10:00:00", margin="80.00"),   # 27 idle
        dict(order_id=3, user_id=3, order_ts="2025-02-28 10:00:00", margin="50.00"),   # 29 idle
        dict(order_id=4, user_id=3, order_ts="2025-02-27 10:00:00", margin="0.00",
             order_status="cancelled"),
        dict(order_id=5, user_id=4, order_ts="2025-03-29 10:00:00"),                   # anchor day
    ])
    got = [(r["user_id"], r["days_inactive"], r["total_margin_rub"], r["delivered_orders_n"])
           for r in kpis.revenue_at_risk(o, limit=2).collect()]
    # equal margin: more idle days first; the limit keeps two rows
    assert got == [(3, 29, 50.0, 1), (1, 28, 50.0, 1)]


def test_channels_count_users_without_orders(spark):
    u = users(spark, [1, 2, 3, 4], channel=["organic", "organic", "organic", "referral"])
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00"),
        dict(order_id=2, user_id=1, order_ts="2025-01-02 10:00:00"),
        dict(order_id=3, user_id=2, order_ts="2025-01-02 10:00:00"),
        dict(order_id=4, user_id=2, order_ts="2025-01-03 10:00:00", order_status="cancelled"),
    ])
    got = {r["acquisition_channel"]: (r["users_n"], r["repeat_purchase_rate"], r["avg_orders_per_user"])
           for r in kpis.repeat_rate_by_channel(u, o).collect()}
    assert got == {"organic": (3, 0.3333, 1.0), "referral": (1, 0.0, 0.0)}


def test_daily_kpis_start_from_session_days(spark):
    s = sessions(spark, [
        dict(session_id=1, user_id=1, start="2025-01-01 09:00:00"),
        dict(session_id=2, user_id=1, start="2025-01-01 10:00:00"),
        dict(session_id=3, user_id=2, start="2025-01-01 11:00:00"),
        dict(session_id=4, user_id=2, start="2025-01-03 11:00:00"),
    ])
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00", basket="100.00", fee="10.00",
             discount="5.00"),
        dict(order_id=2, user_id=1, order_ts="2025-01-01 12:00:00", basket="100.01"),
        dict(order_id=3, user_id=2, order_ts="2025-01-02 12:00:00"),                # order-only day
    ])
    rows = {str(r["dt"]): r for r in kpis.daily_kpis(s, o).collect()}
    assert set(rows) == {"2025-01-01", "2025-01-03"}
    d1 = rows["2025-01-01"]
    assert (d1["dau"], d1["sessions_n"], d1["delivered_orders_n"], d1["buyers_n"]) == (2, 3, 2, 1)
    assert d1["buyer_conversion_from_dau"] == 0.5
    assert d1["aov_rub"] == 100.01          # (100.00 + 100.01) / 2 = 100.005 -> half up
    assert d1["gmv_rub"] == 205.01
    d3 = rows["2025-01-03"]
    assert (d3["delivered_orders_n"], d3["aov_rub"], d3["gmv_rub"]) == (0, 0.0, 0.0)


def test_campaign_range_boundaries(spark):
    o = orders(spark, [
        dict(order_id=1, user_id=1, order_ts="2025-01-10 00:00:00", basket="100.00"),  # start day
        dict(order_id=2, user_id=1, order_ts="2025-01-20 23:59:00", basket="99.99"),   # end day
        dict(order_id=3, user_id=1, order_ts="2025-01-21 00:00:00"),                   # day after
    ])
    c = campaigns(spark, [dict(campaign_id=7, start="2025-01-10", end="2025-01-20", pct="15.00"),
                          dict(campaign_id=8, start="2025-01-20", end="2025-01-25"),
                          dict(campaign_id=9, start="2025-01-21", end="2025-01-10")])  # ends before it starts
    o2 = o.select("order_id", F.to_date("order_ts").alias("order_date"))
    j = joins.date_range_join(o2, "order_date", c, "start_date", "end_date")
    assert {(r["order_id"], r["campaign_id"]) for r in j.collect()} == {(1, 7), (2, 7), (2, 8), (3, 8)}
    got = {(r["order_id"], r["campaign_id"], r["qualifies"], r["potential_discount_rub"])
           for r in quality.active_campaigns(o, c).collect()}
    assert got == {(1, 7, 1, 15.0), (2, 7, 0, 0.0), (2, 8, 0, 0.0), (3, 8, 1, 10.0)}


def test_constraint_violations(spark):
    u = users(spark, [1, 2])
    o = orders(spark, [dict(order_id=1, user_id=1, order_ts="2025-01-01 10:00:00"),
                       dict(order_id=1, user_id=3, order_ts="2025-01-01 10:00:00")])  # dup PK, orphan
    a = spark.createDataFrame(
        [(1, 1, "t", "control", None, "push"), (2, 1, "t", "x" * 40, None, "push")],
        "assignment_id long, user_id long, test_id string, variant string, assigned_at timestamp_ntz, exposure_channel string")
    got = {(r["table_name"], r["rule"], r["column_name"]): r["violations"]
           for r in quality.check_constraints({"dim_users": u, "fact_orders": o,
                                               "fact_ab_test_assignments": a}).collect()}
    assert got[("fact_orders", "primary_key", "order_id")] == 1
    assert got[("fact_orders", "foreign_key", "user_id")] == 1
    assert got[("fact_ab_test_assignments", "unique", "user_id,test_id")] == 1
    assert got[("fact_ab_test_assignments", "not_null", "assigned_at")] == 2
    assert got[("fact_ab_test_assignments", "max_length", "variant")] == 1
    assert got[("dim_users", "primary_key", "user_id")] == 0
    assert ("fact_order_items", "primary_key", "order_item_id") not in got
    assert set(SCHEMAS) >= {k[0] for k in got}

"""One user owning a third of all orders: exact results, bounded rows after pre-aggregation."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from retainr.plans import cohorts, common, experiments
from tests.fixtures import assignments, orders


def _skewed(spark):
    rows, oid = [], 0
    start = datetime(2025, 1, 1, 8, 0)
    for k in range(600):                      # hot user 1: 600 orders over 40 days
        oid += 1
        rows.append(dict(order_id=oid, user_id=1,
                         order_ts=str(start + timedelta(hours=1.6 * k))))
    for u in range(2, 602):                   # 600 other users, 2 orders each
        for j in range(2):
            oid += 1
            rows.append(dict(order_id=oid, user_id=u,
                             order_ts=str(start + timedelta(days=(u % 50) + 20 * j, minutes=u))))
    return orders(spark, rows), pd.DataFrame(rows)


def test_hot_user_results_and_bounded_rows(spark):
    o, pdf = _skewed(spark)
    pdf["order_ts"] = pd.to_datetime(pdf["order_ts"])
    # Q03 by brute force
    anchor = pdf["order_ts"].max()
    first = pdf.groupby("user_id")["order_ts"].min()
    elig = first[first <= anchor - pd.Timedelta(days=30)]
    rep = set()
    for u, f in elig.items():
        ts = pdf.loc[pdf.user_id == u, "order_ts"]
        if ((ts > f) & (ts <= f + pd.Timedelta(days=30))).any():
            rep.add(u)
    want = {}
    for u, f in elig.items():
        m = f.strftime("%Y-%m")
        b, r = want.get(m, (0, 0))
        want[m] = (b + 1, r + (u in rep))
    got = {r["cohort_month"]: (r["users_base"], r["repeat_users_30d"])
           for r in cohorts.repeat_rate_30d_by_month(o).collect()}
    assert got == want
    # after the (user, day) pre-aggregation the hot user has one row per active day
    ud = common.user_days(o)
    hot_days = pdf.loc[pdf.user_id == 1, "order_ts"].dt.date.nunique()
    assert ud.where("user_id = 1").count() == hot_days < 600
    plan = ud._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.index("Exchange hashpartitioning")
    assert "partial_min" in plan[first_exchange:]   # partial aggregate below the first shuffle


def test_hot_user_conversions(spark):
    o, _ = _skewed(spark)
    a = assignments(spark, [dict(user_id=1, variant="treatment", assigned_at="2025-01-10 00:00:00"),
                            dict(user_id=2, variant="control", assigned_at="2025-01-10 00:00:00")])
    got = {r["user_id"]: r["converted"] for r in experiments.conversions(a, o).collect()}
    assert got == {1: 1, 2: 0}

"""Interval joins on timestamps against brute force: open, empty, inverted and ten-year intervals, all kinds of ends."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retainr.operators.joins import FAN, HOUR, interval_join, interval_pieces, micros
from retainr.plans import experiments
from retainr.sources.mapping import canonical_tables
from tests.conftest import SF_SMALL

T0 = dt.datetime(2020, 1, 1)


def _data(seed=5, n=300, m=60):
    rng = random.Random(seed)

    def at(spread):
        return T0 + dt.timedelta(seconds=rng.randint(-spread, spread))

    # a third of the rows belong to user 1
    left = [(i, 1 if i % 3 == 0 else rng.randint(2, 6), None if i % 41 == 0 else at(86_400 * 700)) for i in range(n)]
    right = []
    for j in range(m):
        start = at(86_400 * 700)
        length = rng.choice([0, 1, 3600, 86_400, 86_400 * 40, 86_400 * 3650, -50])
        right.append((j, rng.randint(1, 6), None if j % 7 == 0 else start, None if j % 11 == 0 else start + dt.timedelta(seconds=length)))
    # ends that fall on events exactly
    right += [(m + k, u, ts, ts + dt.timedelta(days=7)) for k, (_, u, ts) in enumerate(left[1:30]) if ts]
    right += [(200 + k, u, ts - dt.timedelta(days=7), ts) for k, (_, u, ts) in enumerate(left[31:50]) if ts]
    return left, right


def _brute(left, right, closed, on):
    def inside(t, s, e):
        if t is None:
            return False
        after = s is None or (t >= s if closed in ("left", "both") else t > s)
        before = e is None or (t <= e if closed in ("right", "both") else t < e)
        return after and before and not (s is not None and e is not None and e < s)

    return sorted((i, j) for i, u, t in left for j, v, s, e in right if (not on or u == v) and inside(t, s, e))


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
@pytest.mark.parametrize("on", [(), ("user_id",)])
def test_interval_join_brute_force(spark, closed, on):
    left, right = _data()
    a = spark.createDataFrame(left, "i long, user_id long, ts timestamp_ntz")
    b = spark.createDataFrame(right, "j long, user_id long, start timestamp_ntz, end timestamp_ntz")
    b = b if on else b.drop("user_id")
    want = _brute(left, right, closed, on)
    got = interval_join(a, "ts", b, "start", "end", "inner", on, closed)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert len(want) > 100
    outer = interval_join(a, "ts", b, "start", "end", "left", on, closed).collect()
    hit = {i for i, _ in want}
    assert sorted((r.i, r.j) for r in outer if r.j is not None) == want
    assert sorted(r.i for r in outer if r.j is None) == sorted(i for i, *_ in left if i not in hit)


def test_edges(spark):
    left, right = _data(n=20, m=5)
    a = spark.createDataFrame(left, "i long, user_id long, ts timestamp_ntz")
    b = spark.createDataFrame(right, "j long, who long, start timestamp_ntz, end timestamp_ntz")
    assert interval_join(a.limit(0), "ts", b, "start", "end").count() == 0
    assert interval_join(a, "ts", b.limit(0), "start", "end").count() == 0
    assert interval_join(a, "ts", b.limit(0), "start", "end", "left").count() == 20
    assert interval_join(a, "ts", b, "start", "end", "left").columns == ["i", "user_id", "ts", "j", "who", "start", "end"]


def test_long_intervals_are_few_bins(spark):
    lengths = [1, 3600, 86_400, 86_400 * 30, 86_400 * 365, 86_400 * 3650, 86_400 * 36_500]
    df = spark.createDataFrame([(k, T0, T0 + dt.timedelta(seconds=s)) for k, s in enumerate(lengths)],
                               "k long, s timestamp_ntz, e timestamp_ntz")
    per = dict(interval_pieces(df, micros(F.col("s")), micros(F.col("e")), HOUR).groupBy("k").count().collect())
    assert len(per) == len(lengths) and max(per.values()) <= FAN


def test_plan_is_an_equi_join(spark):
    left, right = _data()
    a = spark.createDataFrame(left, "i long, user_id long, ts timestamp_ntz")
    b = spark.createDataFrame(right, "j long, who long, start timestamp_ntz, end timestamp_ntz")
    for how in ("inner", "left"):
        plan = interval_join(a, "ts", b, "start", "end", how)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_half_open_conversion_window_agrees(spark):
    """The A/B read-out's [assigned, assigned + 7 days) by the general join."""
    t = canonical_tables(spark, SF_SMALL)
    want = {(r.user_id, r.variant) for r in experiments.conversions(
        t["fact_ab_test_assignments"], t["fact_orders"]).where("converted = 1").collect()}
    exp = experiments.exposures(t["fact_ab_test_assignments"]).withColumn("until", F.timestamp_add("DAY", F.lit(7), "assigned_at"))
    orders = t["fact_orders"].where("order_status = 'delivered'").select("user_id", "order_ts")
    got = interval_join(orders, "order_ts", exp, "assigned_at", "until", on=["user_id"], unit=24 * HOUR)
    assert {(r.user_id, r.variant) for r in got.collect()} == want and want

"""Daily user bitmaps, streaming daily KPIs, features at many cuts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from retainr.checks.compare import compare
from retainr.plans import activity, features, kpis
from retainr.sources.mapping import canonical_tables
from retainr.sources.schemas import SCHEMAS
from retainr.streaming.kpis import start_daily_kpis
from tests.conftest import SF_SMALL
from tests.fixtures import orders


@pytest.fixture(scope="module")
def tables(spark):
    return canonical_tables(spark, SF_SMALL)


def test_stored_days_give_the_same_weeks_and_months(spark, tables, scratch):
    sessions = tables["session_events"]
    # stored in parts: two halves, then a third of all rows again (a repeated load)
    for part in (sessions.where("session_id % 2 = 0"), sessions.where("session_id % 2 = 1"), sessions.where("session_id % 3 = 0")):
        activity.append_days(part, f"{scratch}/days")
    state = activity.stored_days(spark, f"{scratch}/days")
    for mode in ("literal", "monday"):
        ok, message = compare(activity.wau_mau_stickiness(state, mode).toPandas(), kpis.wau_mau_stickiness(sessions, mode).toPandas())
        assert ok, message
    dau = activity.distinct_users(state, F.col("dt"), "dt", "dau")
    want = kpis.daily_kpis(sessions, tables["fact_orders"]).select("dt", "dau")
    assert dau.exceptAll(want).count() == 0 and want.exceptAll(dau).count() == 0
    # one day is read from its own partition
    plan = state.where("dt = '2001-07-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_state_of_ids_far_apart_and_negative(spark):
    ids = [-70_000, -32_768, -1, 0, 1, 32_767, 32_768, 32_769, 10**12, 10**12 + 1]
    df = spark.createDataFrame([(i, f"2025-01-0{1 + k % 2} 10:00:00") for k, i in enumerate(ids * 3)] + [(None, "2025-01-01 00:00:00")],
                               "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp_ntz").alias("session_start_ts"))
    state = activity.merge_days(activity.daily_users(df).unionByName(activity.daily_users(df)))
    assert activity.distinct_users(state, F.lit(1), "all", "n").first()["n"] == len(ids)
    assert activity.distinct_users(activity.daily_users(df.limit(0)), F.lit(1), "all", "n").count() == 0


def _append(df, schema, path):
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).coalesce(1).write.mode("append").parquet(path)


def test_streaming_kpis_equal_the_batch_after_a_restart(spark, tables, scratch):
    s, o = tables["fact_app_sessions"], tables["fact_orders"]
    s = s.where("session_start_ts BETWEEN '2001-06-20' AND '2001-07-05'")
    o = o.where("order_ts BETWEEN '2001-06-20' AND '2001-07-05'")
    ss, os_ = SCHEMAS["fact_app_sessions"], SCHEMAS["fact_orders"]
    a, b, out, ckpt = (os.path.join(scratch, x) for x in ("s", "o", "out", "ckpt"))

    def run():
        start_daily_kpis(spark, a, b, out, ckpt).awaitTermination()

    first = "2001-06-28"
    # a day's late rows: of 27 June, one in five comes with the second load
    late_s, late_o = F.col("session_id") % 5 == 0, F.col("order_id") % 5 == 0
    before_s, before_o = F.col("session_start_ts") < first, F.col("order_ts") < first
    held_s, held_o = F.to_date("session_start_ts") == "2001-06-27", F.to_date("order_ts") == "2001-06-27"
    _append(s.where(before_s & ~(late_s & held_s)), ss, a)
    _append(o.where(before_o & ~(late_o & held_o)), os_, b)
    run()
    # restarted: the rest, the late rows, and rows of 27 June that were already there
    _append(s.where(~before_s | held_s), ss, a)
    _append(o.where(~before_o | held_o), os_, b)
    run()
    # a row that is weeks late, and a far one that closes all days
    one = s.limit(1)
    far = F.lit("2001-09-01 00:00:00").cast("timestamp_ntz")
    _append(one.withColumns({"session_id": F.lit(-1), "session_start_ts": far, "session_end_ts": far}), ss, a)
    run()
    old = F.lit("2001-06-21 00:00:00").cast("timestamp_ntz")
    _append(one.withColumns({"session_id": F.lit(-2), "session_start_ts": old, "session_end_ts": old}), ss, a)
    run()
    got = spark.read.parquet(out)
    want = kpis.daily_kpis(s, o)
    assert got.count() >= 14
    ok, message = compare(got.toPandas(), want.toPandas())
    assert ok, message


CUTS = [f"{y}-{m:02d}-15 12:00:00" for y in (1996, 1999) for m in (1, 2, 3, 6)] + [
    "1994-01-01 00:00:00", "2001-06-30 23:59:59", "2001-07-02 00:00:00", "2003-01-01 00:00:00"]


def test_features_at_many_cuts_equal_one_cut_each(spark, tables):
    args = tables["dim_users"], tables["fact_orders"], tables["session_events"], tables["fact_ab_test_assignments"]
    got = features.user_features_at(*args, CUTS, test_id="free_delivery_banner_v1").toPandas()
    assert len(got) == len(CUTS) * tables["dim_users"].count()
    for cut in CUTS:
        want = features.user_features(*args, reference_date=cut, test_id="free_delivery_banner_v1").toPandas()
        mine = got[got.reference_ts == cut].drop(columns="reference_ts")
        ok, message = compare(mine, want)
        assert ok, (cut, message)


def test_features_at_edges(spark, tables):
    u = tables["dim_users"].limit(3)
    rest = tables["fact_orders"], tables["session_events"], tables["fact_ab_test_assignments"]
    assert features.user_features_at(u, *rest, [], test_id="x").count() == 0
    twice = features.user_features_at(u, *rest, ["2000-01-01", dt.datetime(2000, 1, 1)], test_id="x")
    assert twice.count() == 3  # a cut is a time: written in two ways it is one
    # a day cut in two: its second half adds an order and no day
    o = orders(spark, [dict(order_id=k, user_id=1, order_ts=f"2025-01-01 {h:02d}:00:00") for k, h in enumerate((8, 13, 20))])
    users = u.withColumn("user_id", F.lit(1).cast("long")).limit(1)
    rows = features.user_features_at(users, o, rest[1].limit(0), rest[2].limit(0), ["2025-01-01 12:00:00", "2025-01-01 23:00:00"],
                                     test_id="x").orderBy("reference_ts").collect()
    assert [(r.total_orders, r.active_order_days, r.future_orders_cnt) for r in rows] == [(1, 1, 2), (3, 1, 0)]

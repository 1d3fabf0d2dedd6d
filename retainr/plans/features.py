"""Point-in-time user features with a churn label.

``user_features`` cuts every input at one reference time, aggregates orders, sessions and
assignments to one row per user and left-joins them onto the users; the label counts delivered
orders in ``(reference, reference + horizon]``.  The reference time is a scalar subquery
(``max(order_ts) - horizon``, or the last registration when there are no orders), so the whole
feature table is one lazy plan.

Scale notes: the three per-user aggregates and the future-order count all hash-partition on
``user_id`` after partial aggregation, so the join chain onto the users runs on co-partitioned
one-row-per-user relations (sort-merge joins without further exchanges of the facts); a hot
user is reduced to one row before any join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.functions.dates import elapsed_days_floor, minutes_between, plus_days
from retainr.functions.numeric import clip
from retainr.plans.common import delivered
from retainr.plans.encoding import CategoryEncoder, CategoryEncoderModel

LABEL_HORIZON_DAYS = 30
INACTIVITY_THRESHOLD_DAYS = 28
MISSING_DAYS = 999
SESSION_MINUTES_MIN = 0.1
SESSION_MINUTES_MAX = 240.0
CATEGORICAL_COLUMNS = ["acquisition_channel", "city", "device_os", "gender", "loyalty_tier",
                       "variant"]
DATE_COLUMNS = ["registration_ts", "first_order_ts", "last_order_ts", "last_session_ts",
                "assigned_at"]

# Fill values for users without orders / sessions / assignment before the reference time.
NUMERIC_DEFAULTS = {
    "total_orders": 0, "total_gmv_rub": 0.0, "avg_order_value_rub": 0.0,
    "avg_discount_rub": 0.0, "avg_delivery_fee_rub": 0.0, "avg_delivery_minutes": 0.0,
    "avg_margin_rub": 0.0, "active_order_days": 0, "avg_orders_per_active_day": 0.0,
    "total_sessions": 0, "avg_session_minutes": 0.0, "push_open_rate": 0.0,
    "session_to_order_rate": 0.0, "is_treatment": 0,
}


def _mean(c: str) -> Column:
    """Mean as double from an exact (decimal / long) sum."""
    return F.sum(c).cast("double") / F.count(c)


def order_features(orders: DataFrame) -> DataFrame:
    """per user over delivered orders."""
    agg = delivered(orders).groupBy("user_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("basket_value_rub").cast("double").alias("total_gmv_rub"),
        _mean("basket_value_rub").alias("avg_order_value_rub"),
        _mean("discount_rub").alias("avg_discount_rub"),
        _mean("delivery_fee_rub").alias("avg_delivery_fee_rub"),
        _mean("delivery_minutes").alias("avg_delivery_minutes"),
        _mean("gross_margin_rub").alias("avg_margin_rub"),
        F.min("order_ts").alias("first_order_ts"),
        F.max("order_ts").alias("last_order_ts"),
        F.count_distinct(F.to_date("order_ts")).alias("active_order_days"),
    )
    per_day = col("total_orders").cast("double") / F.nullif(col("active_order_days"), F.lit(0))
    return agg.withColumn("avg_orders_per_active_day", F.coalesce(per_day, F.lit(0.0)))


def session_features(sessions: DataFrame) -> DataFrame:
    """F2: per user; session minutes clipped to [0.1, 240]."""
    minutes = clip(minutes_between("session_start_ts", "session_end_ts"),
                   SESSION_MINUTES_MIN, SESSION_MINUTES_MAX)
    return (
        sessions.withColumn("session_minutes", minutes)
        .groupBy("user_id")
        .agg(F.count("session_id").alias("total_sessions"),
             F.avg("session_minutes").alias("avg_session_minutes"),
             _mean("is_push_opened").alias("push_open_rate"),
             _mean("did_order").alias("session_to_order_rate"),
             F.max("session_start_ts").alias("last_session_ts"))
    )


def ab_features(assignments: DataFrame, test_id: str | None = None) -> DataFrame:
    """variant, is_treatment, assigned_at (one test when ``test_id`` is given, trap T17)."""
    a = assignments if test_id is None else assignments.where(col("test_id") == test_id)
    return a.select("user_id", "variant",
                    (col("variant") == "treatment").cast("int").alias("is_treatment"),
                    "assigned_at")


def _one_per_user(assigned: DataFrame) -> DataFrame:
    one = assigned.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in assigned.columns if c != "user_id"])
    twice = F.raise_error(F.concat(F.lit("more than one assignment to the test for user "), col("user_id").cast("string")))
    return one.withColumn("is_treatment", F.when(col("__n") == 1, col("is_treatment")).otherwise(twice.cast("int"))).drop("__n")


def reference_time(users: DataFrame, orders: DataFrame,
                   label_horizon_days: int = LABEL_HORIZON_DAYS,
                   reference_date: str | _dt.datetime | None = None) -> Column:
    """Feature cut: the given date, else last order (any status, trap T16) minus the horizon,
    else (no orders) the last registration."""
    if reference_date is not None:
        return F.lit(str(reference_date)).cast("timestamp_ntz")
    last_order = orders.select(F.max("order_ts")).scalar()
    last_reg = users.select(F.max("registration_ts")).scalar()
    return F.coalesce(plus_days(last_order, -label_horizon_days), last_reg)


def user_features(users: DataFrame, orders: DataFrame, sessions: DataFrame,
                  assignments: DataFrame, label_horizon_days: int = LABEL_HORIZON_DAYS,
                  inactivity_threshold_days: int = INACTIVITY_THRESHOLD_DAYS,
                  reference_date: str | _dt.datetime | None = None,
                  *, test_id: str) -> DataFrame:
    """one row per user with history up to the reference time and the churn label.

    ``test_id`` names the one test whose assignments are used (trap T17); a user assigned to it more
    than once makes the query fail instead of doubling rows."""
    ref = reference_time(users, orders, label_horizon_days, reference_date)
    of = order_features(orders.where(col("order_ts") <= ref))
    sf = session_features(sessions.where(col("session_start_ts") <= ref))
    af = _one_per_user(ab_features(assignments.where(col("assigned_at") <= ref), test_id))
    future = (
        delivered(orders)
        .where((col("order_ts") > ref) & (col("order_ts") <= plus_days(ref, label_horizon_days)))
        .groupBy("user_id").agg(F.count("order_id").alias("future_orders_cnt"))
    )
    # the reference time becomes a column once: each mention of the scalar would be planned again
    f = users.withColumn("__ref", ref).join(of, "user_id", "left").join(sf, "user_id", "left").join(af, "user_id", "left")
    return _derived(f.join(future, "user_id", "left"), inactivity_threshold_days).drop("__ref")


def _derived(f: DataFrame, inactivity_threshold_days: int) -> DataFrame:
    """Fill defaults and add gaps, ratios, eligibility and label to users joined with their history up to ``__ref``."""

    def gap(name: str) -> Column:
        return F.coalesce(elapsed_days_floor(col("__ref"), col(name)), F.lit(MISSING_DAYS))

    f = f.select(
        *[c for c in f.columns if c not in NUMERIC_DEFAULTS and c != "future_orders_cnt"],
        *[F.coalesce(col(c), F.lit(v)).alias(c) for c, v in NUMERIC_DEFAULTS.items()],
        F.greatest(elapsed_days_floor(col("__ref"), col("registration_ts")), F.lit(0))
        .alias("days_since_registration"),
        gap("last_order_ts").alias("days_since_last_order"),
        gap("last_session_ts").alias("days_since_last_session"),
        gap("assigned_at").alias("days_since_assignment"),
        F.coalesce("future_orders_cnt", F.lit(0)).cast("long").alias("future_orders_cnt"),
    )
    days = col("days_since_registration") + 1
    eligible_now = (col("total_orders") > 0) & (col("days_since_last_order") <= inactivity_threshold_days)
    return f.select(
        *[c for c in f.columns if c != "future_orders_cnt"],
        (col("total_orders") / days).alias("order_intensity"),
        (col("total_gmv_rub") / days).alias("gmv_per_day"),
        (col("total_sessions") / days).alias("engagement_ratio"),
        eligible_now.cast("int").alias("is_model_eligible"),
        "future_orders_cnt",
        (col("future_orders_cnt") == 0).cast("int").alias("churn_label"))


# What a history adds up to, as (sum, count) pairs for the means; money stays decimal.
_ORDER_SUMS = ("basket_value_rub", "discount_rub", "delivery_fee_rub", "delivery_minutes", "gross_margin_rub")
_SESSION_SUMS = ("session_minutes", "is_push_opened", "did_order")


def user_features_at(users: DataFrame, orders: DataFrame, sessions: DataFrame, assignments: DataFrame,
                     cuts: list[str | _dt.datetime], label_horizon_days: int = LABEL_HORIZON_DAYS,
                     inactivity_threshold_days: int = INACTIVITY_THRESHOLD_DAYS, *, test_id: str) -> DataFrame:
    """F4 at many reference times in one sweep: for each user and cut, ``reference_ts`` and the columns that ``user_features`` with that
    ``reference_date`` has.

    Every event is counted once, at the first cut that is not before it: a table is scanned and reduced to one row for each user
    and cut, whatever the number of cuts.  A running sum over a user's cuts then gives every history; sums, counts, minima and
    maxima add up, and a day with orders counts where its first order does.  An order is in the future of each cut whose horizon
    holds it, which are as many as cuts lie within the horizon.  A hot user is as many rows as there are cuts before anything is
    windowed.

    Cuts are distinct times, sorted here; none gives no rows.  Events after the last cut belong to no history."""
    times = sorted({_dt.datetime.fromisoformat(str(c)) for c in cuts})
    at = F.array(*[F.lit(str(t)).cast("timestamp_ntz") for t in times]) if times else F.array().cast("array<timestamp_ntz>")
    n = len(times)

    def first_cut(ts: Column) -> Column:
        """Number of cuts before ts: 0 .. n, n for none at or after it."""
        return F.size(F.filter(at, lambda c: c < ts))

    def sums(names: tuple[str, ...]) -> list[Column]:
        return [f(c).alias(f"{k}_{c}") for c in names for k, f in (("s", F.sum), ("n", F.count))]

    bought = delivered(orders).withColumn("k", first_cut(col("order_ts")))
    past = bought.where(col("k") < n)
    of = past.groupBy("user_id", "k").agg(
        F.count("order_id").alias("total_orders"), *sums(_ORDER_SUMS),
        F.min("order_ts").alias("first_order_ts"), F.max("order_ts").alias("last_order_ts"))
    days = past.groupBy("user_id", F.to_date("order_ts").alias("d")).agg(F.min("k").alias("k")).groupBy("user_id", "k").agg(
        F.count(F.lit(1)).alias("active_order_days"))
    minutes = clip(minutes_between("session_start_ts", "session_end_ts"), SESSION_MINUTES_MIN, SESSION_MINUTES_MAX)
    sf = sessions.withColumns({"session_minutes": minutes, "k": first_cut(col("session_start_ts"))}).where(col("k") < n).groupBy(
        "user_id", "k").agg(F.count("session_id").alias("total_sessions"), *sums(_SESSION_SUMS),
                            F.max("session_start_ts").alias("last_session_ts"))
    horizon = F.filter(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: (F.get(at, i) < col("order_ts")) & (
        col("order_ts") <= plus_days(F.get(at, i), label_horizon_days)))
    future = delivered(orders).select("user_id", "order_id", F.explode(horizon).alias("k")).groupBy("user_id", "k").agg(
        F.count("order_id").alias("future_orders_cnt"))
    grid = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")).alias("k"))
    grid = grid.withColumn("__row", F.lit(True))
    parts = grid
    for part in (of, days, sf, future):
        parts = parts.unionByName(part, allowMissingColumns=True)
    so_far = Window.partitionBy("user_id").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy("user_id", "k")
    added = ["total_orders", "active_order_days", "total_sessions", *[f"{k}_{c}" for c in (*_ORDER_SUMS, *_SESSION_SUMS) for k in "sn"]]
    run = parts.withColumns(
        {c: F.sum(c).over(so_far) for c in added}
        | {"first_order_ts": F.min("first_order_ts").over(so_far)}
        | {c: F.max(c).over(so_far) for c in ("last_order_ts", "last_session_ts")}
        | {"future_orders_cnt": F.sum("future_orders_cnt").over(here)}).where("__row")

    def mean(c: str) -> Column:
        return col(f"s_{c}").cast("double") / F.nullif(col(f"n_{c}"), F.lit(0))

    per_day = col("total_orders").cast("double") / F.nullif(col("active_order_days"), F.lit(0))
    history = run.select(
        "user_id", "k", "total_orders", col("s_basket_value_rub").cast("double").alias("total_gmv_rub"),
        mean("basket_value_rub").alias("avg_order_value_rub"), mean("discount_rub").alias("avg_discount_rub"),
        mean("delivery_fee_rub").alias("avg_delivery_fee_rub"), mean("delivery_minutes").alias("avg_delivery_minutes"),
        mean("gross_margin_rub").alias("avg_margin_rub"), "first_order_ts", "last_order_ts", "active_order_days",
        F.when(col("total_orders") > 0, F.coalesce(per_day, F.lit(0.0))).alias("avg_orders_per_active_day"),
        "total_sessions", mean("session_minutes").alias("avg_session_minutes"), mean("is_push_opened").alias("push_open_rate"),
        mean("did_order").alias("session_to_order_rate"), "last_session_ts", "future_orders_cnt")
    assigned = ab_features(assignments, test_id)
    af = _one_per_user(assigned.where(col("assigned_at") <= F.array_max(at)))
    f = users.join(history, "user_id").join(af, "user_id", "left").withColumn("__ref", F.get(at, col("k")))
    known = col("assigned_at") <= col("__ref")
    f = f.withColumns({c: F.when(known, col(c)) for c in ("variant", "is_treatment", "assigned_at")}).drop("k")
    return _derived(f, inactivity_threshold_days).withColumnRenamed("__ref", "reference_ts")


def eligible(features: DataFrame) -> DataFrame:
    """The rows a model is made for."""
    return features.where(col("is_model_eligible") == 1) if "is_model_eligible" in features.columns else features


def modeling_dataset(features: DataFrame, eligible_only: bool = True, encoder: CategoryEncoderModel | None = None) -> DataFrame:
    """eligible rows, categoricals NULL -> 'unknown', dates and the flag dropped, one 0/1
    column ``<col>_<value>`` per category value (none dropped).

    With a fitted ``encoder`` this is a lazy projection and the columns are those that it learned; without one the values
    present are read first, because they become column names."""
    df = eligible(features) if eligible_only else features
    encoder = encoder or CategoryEncoder(inputCols=CATEGORICAL_COLUMNS).fit(df)
    return encoder.transform(df).drop(*DATE_COLUMNS, "is_model_eligible")

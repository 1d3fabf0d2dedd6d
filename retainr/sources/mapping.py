"""Driver tables -> canonical star schema (FIXTURES.md part A).

The driver ships TPC-H-like tables; the analyses run on the eight canonical tables of the
retention schema.  The mapping is column expressions only: every canonical table is a lazy
projection (plus joins to the bounded geography dimension) of a Parquet scan.

Scale notes
* nation (25 rows by TPC-H definition) x region (5 rows): AQE broadcasts it once measured.
* sessions look up ``city`` / ``device_os`` on ``dim_users``; both sides grow with the data, so
  that is a regular equi-join that AQE may turn into a broadcast once it has measured sizes.
* Orders and events are mapped row by row (narrow), no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retainr.functions.columns import col

# Fixed values of the mapping (FIXTURES.md part A), in natural order.
CHANNELS = ["organic", "paid_search", "social_ads", "referral", "affiliate"]
TIERS = {"AUTOMOBILE": "platinum", "BUILDING": "gold", "FURNITURE": "silver"}
DEFAULT_TIER = "new"
CUISINES = ["cuisine_a", "cuisine_b", "cuisine_c"]
COURIER_TYPES = ["bike", "car", "foot"]
SHIFT_TYPES = ["shift_a", "shift_b", "shift_c"]
CAMPAIGN_TYPES = ["free_delivery", "percent_discount", "combo_offer", "reactivation"]
PAYMENT_METHODS = ["card", "sbp", "apple_pay", "google_pay"]
ORDER_SESSION_SOURCES = ["push", "organic", "paid", "email", "direct"]
EVENT_SESSION_SOURCES = {"click": "push", "view": "organic", "purchase": "paid",
                         "signup": "email", "error": "direct"}
ITEM_CATEGORIES = ["main", "snack", "drink", "dessert"]
EXPOSURE_CHANNELS = ["home_feed", "push", "search"]
TEST_ID = "free_delivery_banner_v1"
EVENT_SHIFT_DAYS = 8234
CAMPAIGN_SLOTS = 80
SESSION_ID_OFFSET = 10_000_000

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events"]
CANONICAL_TABLES = ["dim_users", "dim_restaurants", "dim_couriers", "dim_promo_campaigns",
                    "fact_orders", "fact_order_items", "fact_app_sessions",
                    "fact_ab_test_assignments"]


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] for a 0-based integer index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _lookup(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(F.lit(default)) if default is not None else out


def _plus_days(ts: Column, n: Column) -> Column:
    return F.timestamp_add("DAY", n.cast("int"), ts)


def _plus_minutes(ts: Column, n: Column) -> Column:
    return F.timestamp_add("MINUTE", n.cast("int"), ts)


class _LazyReads(dict):
    """Driver tables, each read (file listing + footer) only when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        self[name] = df
        return df


def read_driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _LazyReads(spark, sf_dir)


def _geo(raw: dict[str, DataFrame]) -> DataFrame:
    """nation x region (25 x 5 rows by TPC-H definition); AQE broadcasts it by its measured size."""
    nation, region = raw["nation"], raw["region"]
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", col("r_name").alias("geo_city")))


def map_users(raw: dict[str, DataFrame]) -> DataFrame:
    c = raw["customer"]
    k = col("c_custkey")
    return (
        c.join(_geo(raw), c.c_nationkey == col("n_nationkey"))
        .select(
            k.alias("user_id"),
            _plus_days(F.lit("1994-06-01 00:00:00").cast("timestamp_ntz"), k % 200)
            .alias("registration_ts"),
            _pick(k % 5, CHANNELS).alias("acquisition_channel"),
            col("geo_city").alias("city"),
            F.when(k % 4 < 2, "iOS").otherwise("Android").alias("device_os"),
            (18 + k % 43).cast("int").alias("age"),
            F.when(k % 3 == 0, "male").otherwise("female").alias("gender"),
            _lookup(col("c_mktsegment"), TIERS, DEFAULT_TIER).alias("loyalty_tier"),
        )
    )


def map_restaurants(raw: dict[str, DataFrame]) -> DataFrame:
    s = raw["supplier"]
    k = col("s_suppkey")
    return (
        s.join(_geo(raw), s.s_nationkey == col("n_nationkey"))
        .select(
            k.alias("restaurant_id"),
            col("s_name").alias("restaurant_name"),
            _pick(k % 3, CUISINES).alias("cuisine_type"),
            col("geo_city").alias("city"),
            (12 + k % 34).cast("int").alias("average_prep_minutes"),
            ((32 + k % 18) / 10).cast("decimal(3,2)").alias("rating"),
        )
    )


def map_couriers(raw: dict[str, DataFrame]) -> DataFrame:
    s = raw["supplier"]
    k = col("s_suppkey")
    return (
        s.join(_geo(raw), s.s_nationkey == col("n_nationkey"))
        .select(
            k.alias("courier_id"),
            col("geo_city").alias("city"),
            _pick(k % 3, COURIER_TYPES).alias("courier_type"),
            _pick(k % 3, SHIFT_TYPES).alias("shift_type"),
            F.date_add(F.lit("1994-01-01").cast("date"), (k % 365).cast("int")).alias("hire_date"),
            (8 + k % 22).cast("decimal(5,2)").alias("avg_speed_kmh"),
            ((65 + k % 34) / 100).cast("decimal(5,4)").alias("on_time_rate"),
        )
    )


def map_campaigns(raw: dict[str, DataFrame]) -> DataFrame:
    """One campaign a month slot: all parts, by key modulo the number of slots."""
    slots = raw["part"].groupBy((col("p_partkey") % CAMPAIGN_SLOTS).alias("k")).agg(
        F.min("p_name").alias("campaign_name"))
    k = col("k")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (30 * k).cast("int"))
    return slots.select(
        k.alias("campaign_id"),
        "campaign_name",
        start.alias("start_date"),
        F.date_add(start, (6 + k % 8).cast("int")).alias("end_date"),
        (8 + k % 22).cast("decimal(5,2)").alias("discount_pct"),
        (50000 + (k % 10) * 20000).cast("decimal(12,2)").alias("min_basket_rub"),
        _pick(k % 4, CAMPAIGN_TYPES).alias("campaign_type"),
    )


def _order_ts(k: Column) -> Column:
    return _plus_minutes(col("o_orderdate"), k % 1440)


def map_orders(raw: dict[str, DataFrame]) -> DataFrame:
    o = raw["orders"]
    k = col("o_orderkey")
    return o.select(
        k.alias("order_id"),
        col("o_custkey").alias("user_id"),
        (k % 10).alias("restaurant_id"),
        (k % 7).alias("courier_id"),
        F.when(k % 4 == 0, k % CAMPAIGN_SLOTS).alias("campaign_id"),
        _order_ts(k).alias("order_ts"),
        F.when(col("o_orderstatus") == "P", "cancelled").otherwise("delivered")
        .alias("order_status"),
        (12 + (7 * k) % 60).cast("int").alias("delivery_minutes"),
        col("o_totalprice").cast("decimal(12,2)").alias("basket_value_rub"),
        (49 + k % 160).cast("decimal(12,2)").alias("delivery_fee_rub"),
        F.when(k % 3 == 0, k % 97).otherwise(0).cast("decimal(12,2)").alias("discount_rub"),
        _pick(k % 4, PAYMENT_METHODS).alias("payment_method"),
        ((k % 160) / 10).cast("decimal(8,2)").alias("distance_km"),
        (k % 6 == 0).cast("int").alias("is_express"),
        ((13 * k) % 1700 - 200).cast("decimal(12,2)").alias("gross_margin_rub"),
    )


def map_order_items(raw: dict[str, DataFrame]) -> DataFrame:
    li, p = raw["lineitem"], raw["part"]
    unit = col("p_retailprice").cast("decimal(12,2)")
    return (
        li.join(p, li.l_partkey == p.p_partkey)
        .select(
            (10 * col("l_orderkey") + col("l_linenumber")).alias("order_item_id"),
            col("l_orderkey").alias("order_id"),
            col("p_name").alias("item_name"),
            _pick(col("l_partkey") % 4, ITEM_CATEGORIES).alias("item_category"),
            col("l_quantity").cast("int").alias("quantity"),
            unit.alias("unit_price_rub"),
            (unit * F.lit(0.45).cast("decimal(3,2)")).cast("decimal(12,2)").alias("cogs_rub"),
        )
    )


def map_session_events(raw: dict[str, DataFrame]) -> DataFrame:
    """The sessions with the columns of their own; ``city`` and ``device_os`` are the user's."""
    o, ev = raw["orders"], raw["events"]
    k = col("o_orderkey")
    ordering = (
        o.where(col("o_orderstatus") != "P")
        .select(
            (F.lit(SESSION_ID_OFFSET) + k).alias("session_id"),
            col("o_custkey").alias("user_id"),
            _plus_minutes(_order_ts(k), -(3 + k % 60)).alias("session_start_ts"),
            _order_ts(k).alias("session_end_ts"),
            _pick(k % 5, ORDER_SESSION_SOURCES).alias("session_source"),
            (k % 3 == 0).cast("int").alias("is_push_opened"),
            F.lit(1).alias("did_order"),
        )
    )
    start = _plus_days(col("ts"), F.lit(-EVENT_SHIFT_DAYS))
    browsing = ev.select(
        col("event_id").alias("session_id"),
        col("user_id"),
        start.alias("session_start_ts"),
        _plus_minutes(start, 1 + col("event_id") % 40).alias("session_end_ts"),
        _lookup(col("event_type"), EVENT_SESSION_SOURCES).alias("session_source"),
        (col("event_type") == "click").cast("int").alias("is_push_opened"),
        F.lit(0).alias("did_order"),
    )
    return ordering.unionByName(browsing)


def map_sessions(raw: dict[str, DataFrame], users: DataFrame | None = None) -> DataFrame:
    users = users if users is not None else map_users(raw)
    who = users.select("user_id", "city", "device_os")
    return (
        map_session_events(raw)
        .join(who, "user_id", "left")
        .select("session_id", "user_id", "session_start_ts", "session_end_ts", "session_source",
                "city", "device_os", "is_push_opened", "did_order")
    )


def map_assignments(raw: dict[str, DataFrame]) -> DataFrame:
    c = raw["customer"]
    k = col("c_custkey")
    day = ((k - k % 2) % 90)
    return (
        c.select(
            (k + 1).alias("assignment_id"),
            k.alias("user_id"),
            F.lit(TEST_ID).alias("test_id"),
            F.when(k % 2 == 0, "control").otherwise("treatment").alias("variant"),
            _plus_minutes(_plus_days(F.lit("2001-05-01 00:00:00").cast("timestamp_ntz"), day),
                          k % 1440).alias("assigned_at"),
            _pick(k % 3, EXPOSURE_CHANNELS).alias("exposure_channel"),
        )
    )


SESSION_EVENTS = "session_events"


class CanonicalTables(Mapping):
    """The eight canonical tables over the driver's Parquet files, as lazy plans.

    A table is built on first access only, so a query touching ``fact_orders`` never resolves
    the other files; nothing is read or written before an action.  Loading the mapped tables into
    stored ones is a separate, explicit step: ``sources.layout.write_layout`` to a path of the caller's.

    Beside them, ``SESSION_EVENTS`` is a view of the sessions without the two columns looked up from the users; a query that names neither
    takes it and scans no users.
    """

    _builders = {
        "dim_users": lambda self: map_users(self._raw),
        "dim_restaurants": lambda self: map_restaurants(self._raw),
        "dim_couriers": lambda self: map_couriers(self._raw),
        "dim_promo_campaigns": lambda self: map_campaigns(self._raw),
        "fact_orders": lambda self: map_orders(self._raw),
        "fact_order_items": lambda self: map_order_items(self._raw),
        "fact_app_sessions": lambda self: map_sessions(self._raw, self["dim_users"]),
        SESSION_EVENTS: lambda self: map_session_events(self._raw),
        "fact_ab_test_assignments": lambda self: map_assignments(self._raw),
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._raw = read_driver_tables(spark, sf_dir)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self):
        return iter(CANONICAL_TABLES)

    def __len__(self) -> int:
        return len(CANONICAL_TABLES)


def canonical_tables(spark: SparkSession, sf_dir: str) -> CanonicalTables:
    """Canonical tables for ``sf_dir``."""
    return CanonicalTables(spark, sf_dir)

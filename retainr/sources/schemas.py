"""Declared schema of the eight canonical tables.

Types follow the relational DDL of the star schema: BIGINT keys -> long, INT -> int,
TINYINT flags -> int (they are averaged), VARCHAR -> string, DECIMAL(p,s) -> decimal(p,s),
DATETIME -> timestamp_ntz (zone-free), DATE -> date.  Only ``fact_orders.campaign_id`` may be
NULL; every other column is NOT NULL by contract (checked by ``plans.quality.check_constraints``).
"""

from __future__ import annotations

from pyspark.sql import types as T


def _f(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable)


LONG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()
TS, DATE = T.TimestampNTZType(), T.DateType()


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


MONEY = dec(12, 2)

SCHEMAS: dict[str, T.StructType] = {
    "dim_users": T.StructType([
        _f("user_id", LONG), _f("registration_ts", TS), _f("acquisition_channel", STR),
        _f("city", STR), _f("device_os", STR), _f("age", INT), _f("gender", STR),
        _f("loyalty_tier", STR),
    ]),
    "dim_restaurants": T.StructType([
        _f("restaurant_id", LONG), _f("restaurant_name", STR), _f("cuisine_type", STR),
        _f("city", STR), _f("average_prep_minutes", INT), _f("rating", dec(3, 2)),
    ]),
    "dim_couriers": T.StructType([
        _f("courier_id", LONG), _f("city", STR), _f("courier_type", STR), _f("shift_type", STR),
        _f("hire_date", DATE), _f("avg_speed_kmh", dec(5, 2)), _f("on_time_rate", dec(5, 4)),
    ]),
    "dim_promo_campaigns": T.StructType([
        _f("campaign_id", LONG), _f("campaign_name", STR), _f("start_date", DATE),
        _f("end_date", DATE), _f("discount_pct", dec(5, 2)), _f("min_basket_rub", MONEY),
        _f("campaign_type", STR),
    ]),
    "fact_orders": T.StructType([
        _f("order_id", LONG), _f("user_id", LONG), _f("restaurant_id", LONG),
        _f("courier_id", LONG), _f("campaign_id", LONG, True), _f("order_ts", TS),
        _f("order_status", STR), _f("delivery_minutes", INT), _f("basket_value_rub", MONEY),
        _f("delivery_fee_rub", MONEY), _f("discount_rub", MONEY), _f("payment_method", STR),
        _f("distance_km", dec(8, 2)), _f("is_express", INT), _f("gross_margin_rub", MONEY),
    ]),
    "fact_order_items": T.StructType([
        _f("order_item_id", LONG), _f("order_id", LONG), _f("item_name", STR),
        _f("item_category", STR), _f("quantity", INT), _f("unit_price_rub", MONEY),
        _f("cogs_rub", MONEY),
    ]),
    "fact_app_sessions": T.StructType([
        _f("session_id", LONG), _f("user_id", LONG), _f("session_start_ts", TS),
        _f("session_end_ts", TS), _f("session_source", STR), _f("city", STR),
        _f("device_os", STR), _f("is_push_opened", INT), _f("did_order", INT),
    ]),
    "fact_ab_test_assignments": T.StructType([
        _f("assignment_id", LONG), _f("user_id", LONG), _f("test_id", STR), _f("variant", STR),
        _f("assigned_at", TS), _f("exposure_channel", STR),
    ]),
}

# Keys and declared lengths, used by the constraint checker.
PRIMARY_KEYS: dict[str, list[str]] = {
    "dim_users": ["user_id"],
    "dim_restaurants": ["restaurant_id"],
    "dim_couriers": ["courier_id"],
    "dim_promo_campaigns": ["campaign_id"],
    "fact_orders": ["order_id"],
    "fact_order_items": ["order_item_id"],
    "fact_app_sessions": ["session_id"],
    "fact_ab_test_assignments": ["assignment_id"],
}

UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "fact_ab_test_assignments": [["user_id", "test_id"]],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("fact_orders", "user_id", "dim_users", "user_id"),
    ("fact_orders", "restaurant_id", "dim_restaurants", "restaurant_id"),
    ("fact_orders", "courier_id", "dim_couriers", "courier_id"),
    ("fact_orders", "campaign_id", "dim_promo_campaigns", "campaign_id"),
    ("fact_order_items", "order_id", "fact_orders", "order_id"),
    ("fact_app_sessions", "user_id", "dim_users", "user_id"),
    ("fact_ab_test_assignments", "user_id", "dim_users", "user_id"),
]

# Declared VARCHAR lengths of the DDL.
VARCHAR_LENGTHS: dict[str, dict[str, int]] = {
    "dim_users": {"acquisition_channel": 32, "city": 64, "device_os": 16, "gender": 16,
                  "loyalty_tier": 16},
    "dim_restaurants": {"restaurant_name": 128, "cuisine_type": 64, "city": 64},
    "dim_couriers": {"city": 64, "courier_type": 16, "shift_type": 16},
    "dim_promo_campaigns": {"campaign_name": 128, "campaign_type": 32},
    "fact_orders": {"order_status": 16, "payment_method": 32},
    "fact_order_items": {"item_name": 128, "item_category": 32},
    "fact_app_sessions": {"session_source": 32, "city": 64, "device_os": 16},
    "fact_ab_test_assignments": {"test_id": 64, "variant": 32, "exposure_channel": 32},
}

TIMESTAMP_COLUMNS: dict[str, list[str]] = {
    name: [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    for name, schema in SCHEMAS.items()
}

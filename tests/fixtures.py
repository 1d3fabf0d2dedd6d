"""Hand-built canonical tables (FIXTURES.md part B)."""

from datetime import datetime
from decimal import Decimal

from retainr.sources.schemas import SCHEMAS


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def orders(spark, rows):
    """rows: dicts with order_id, user_id, order_ts and optional other columns."""
    out = []
    for r in rows:
        out.append((
            r["order_id"], r["user_id"], r.get("restaurant_id", 1), r.get("courier_id", 1),
            r.get("campaign_id"), ts(r["order_ts"]), r.get("order_status", "delivered"),
            r.get("delivery_minutes", 30), Decimal(str(r.get("basket", "100.00"))),
            Decimal(str(r.get("fee", "0.00"))), Decimal(str(r.get("discount", "0.00"))),
            r.get("payment_method", "card"), Decimal(str(r.get("km", "1.00"))),
            r.get("is_express", 0), Decimal(str(r.get("margin", "10.00")))))
    return spark.createDataFrame(out, SCHEMAS["fact_orders"])


def assignments(spark, rows):
    out = [(i + 1, r["user_id"], r.get("test_id", "free_delivery_banner_v1"), r["variant"],
            ts(r["assigned_at"]), "push") for i, r in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMAS["fact_ab_test_assignments"])


def users(spark, ids, channel="organic", city="EUROPE"):
    rows = [(i, ts("2024-01-01 00:00:00"), channel if isinstance(channel, str) else channel[k],
             city, "iOS", 30, "male", "gold") for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, SCHEMAS["dim_users"])


def sessions(spark, rows):
    out = [(r["session_id"], r["user_id"], ts(r["start"]), ts(r.get("end", r["start"])),
            "push", "EUROPE", "iOS", 0, r.get("did_order", 0)) for r in rows]
    return spark.createDataFrame(out, SCHEMAS["fact_app_sessions"])


def campaigns(spark, rows):
    from datetime import date
    out = [(r["campaign_id"], "c", date.fromisoformat(r["start"]), date.fromisoformat(r["end"]),
            Decimal(str(r.get("pct", "10.00"))), Decimal(str(r.get("min_basket", "100.00"))),
            "free_delivery") for r in rows]
    return spark.createDataFrame(out, SCHEMAS["dim_promo_campaigns"])

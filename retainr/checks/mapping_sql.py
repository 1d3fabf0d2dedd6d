"""The driver-table -> canonical-table mapping written as DuckDB CTEs.

This is the oracle's own copy of FIXTURES.md part A, kept in SQL (not generated from the Spark
code) so that a mistake in one of the two shows up as a mismatch.  ``with_canonical(body)``
prefixes a query body with the CTEs; the body may start with further ``name AS (...)`` CTEs
joined by a comma, via ``with_canonical(body, extra_ctes=...)``.
"""

from __future__ import annotations

CANONICAL_CTES = """
geo AS (
    SELECT n.n_nationkey, r.r_name AS geo_city
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
dim_users AS (
    SELECT
        c.c_custkey AS user_id,
        TIMESTAMP '1994-06-01 00:00:00' + to_days(CAST(c.c_custkey % 200 AS INTEGER)) AS registration_ts,
        CASE c.c_custkey % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'paid_search' WHEN 2 THEN 'social_ads'
             WHEN 3 THEN 'referral' ELSE 'affiliate' END AS acquisition_channel,
        g.geo_city AS city,
        CASE WHEN c.c_custkey % 4 < 2 THEN 'iOS' ELSE 'Android' END AS device_os,
        CAST(18 + c.c_custkey % 43 AS INTEGER) AS age,
        CASE WHEN c.c_custkey % 3 = 0 THEN 'male' ELSE 'female' END AS gender,
        CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'platinum' WHEN 'BUILDING' THEN 'gold'
             WHEN 'FURNITURE' THEN 'silver' ELSE 'new' END AS loyalty_tier
    FROM customer c JOIN geo g ON c.c_nationkey = g.n_nationkey
),
dim_restaurants AS (
    SELECT
        s.s_suppkey AS restaurant_id,
        s.s_name AS restaurant_name,
        CASE s.s_suppkey % 3 WHEN 0 THEN 'cuisine_a' WHEN 1 THEN 'cuisine_b' ELSE 'cuisine_c' END AS cuisine_type,
        g.geo_city AS city,
        CAST(12 + s.s_suppkey % 34 AS INTEGER) AS average_prep_minutes,
        CAST((32 + s.s_suppkey % 18) / 10 AS DECIMAL(3,2)) AS rating
    FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey
),
dim_couriers AS (
    SELECT
        s.s_suppkey AS courier_id,
        g.geo_city AS city,
        CASE s.s_suppkey % 3 WHEN 0 THEN 'bike' WHEN 1 THEN 'car' ELSE 'foot' END AS courier_type,
        CASE s.s_suppkey % 3 WHEN 0 THEN 'shift_a' WHEN 1 THEN 'shift_b' ELSE 'shift_c' END AS shift_type,
        DATE '1994-01-01' + CAST(s.s_suppkey % 365 AS INTEGER) AS hire_date,
        CAST(8 + s.s_suppkey % 22 AS DECIMAL(5,2)) AS avg_speed_kmh,
        CAST((65 + s.s_suppkey % 34) / 100 AS DECIMAL(5,4)) AS on_time_rate
    FROM supplier s JOIN geo g ON s.s_nationkey = g.n_nationkey
),
dim_promo_campaigns AS (
    SELECT
        p.k AS campaign_id,
        p.campaign_name,
        DATE '1995-01-01' + CAST(30 * p.k AS INTEGER) AS start_date,
        DATE '1995-01-01' + CAST(30 * p.k + 6 + p.k % 8 AS INTEGER) AS end_date,
        CAST(8 + p.k % 22 AS DECIMAL(5,2)) AS discount_pct,
        CAST(50000 + (p.k % 10) * 20000 AS DECIMAL(12,2)) AS min_basket_rub,
        CASE p.k % 4 WHEN 0 THEN 'free_delivery' WHEN 1 THEN 'percent_discount'
             WHEN 2 THEN 'combo_offer' ELSE 'reactivation' END AS campaign_type
    FROM (SELECT p_partkey % 80 AS k, MIN(p_name) AS campaign_name FROM part GROUP BY 1) p
),
fact_orders AS (
    SELECT
        o.o_orderkey AS order_id,
        o.o_custkey AS user_id,
        o.o_orderkey % 10 AS restaurant_id,
        o.o_orderkey % 7 AS courier_id,
        CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_orderkey % 80 END AS campaign_id,
        o.o_orderdate + to_minutes(CAST(o.o_orderkey % 1440 AS INTEGER)) AS order_ts,
        CASE WHEN o.o_orderstatus = 'P' THEN 'cancelled' ELSE 'delivered' END AS order_status,
        CAST(12 + (7 * o.o_orderkey) % 60 AS INTEGER) AS delivery_minutes,
        CAST(o.o_totalprice AS DECIMAL(12,2)) AS basket_value_rub,
        CAST(49 + o.o_orderkey % 160 AS DECIMAL(12,2)) AS delivery_fee_rub,
        CAST(CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderkey % 97 ELSE 0 END AS DECIMAL(12,2)) AS discount_rub,
        CASE o.o_orderkey % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'sbp' WHEN 2 THEN 'apple_pay'
             ELSE 'google_pay' END AS payment_method,
        CAST((o.o_orderkey % 160) / 10 AS DECIMAL(8,2)) AS distance_km,
        CAST(o.o_orderkey % 6 = 0 AS INTEGER) AS is_express,
        CAST((13 * o.o_orderkey) % 1700 - 200 AS DECIMAL(12,2)) AS gross_margin_rub
    FROM orders o
),
fact_order_items AS (
    SELECT
        10 * l.l_orderkey + l.l_linenumber AS order_item_id,
        l.l_orderkey AS order_id,
        p.p_name AS item_name,
        CASE l.l_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'snack' WHEN 2 THEN 'drink'
             ELSE 'dessert' END AS item_category,
        CAST(l.l_quantity AS INTEGER) AS quantity,
        CAST(p.p_retailprice AS DECIMAL(12,2)) AS unit_price_rub,
        CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * CAST(0.45 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS cogs_rub
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
sessions_raw AS (
    SELECT
        10000000 + o.o_orderkey AS session_id,
        o.o_custkey AS user_id,
        o.o_orderdate + to_minutes(CAST(o.o_orderkey % 1440 AS INTEGER))
            - to_minutes(CAST(3 + o.o_orderkey % 60 AS INTEGER)) AS session_start_ts,
        o.o_orderdate + to_minutes(CAST(o.o_orderkey % 1440 AS INTEGER)) AS session_end_ts,
        CASE o.o_orderkey % 5 WHEN 0 THEN 'push' WHEN 1 THEN 'organic' WHEN 2 THEN 'paid'
             WHEN 3 THEN 'email' ELSE 'direct' END AS session_source,
        CAST(o.o_orderkey % 3 = 0 AS INTEGER) AS is_push_opened,
        1 AS did_order
    FROM orders o
    WHERE o.o_orderstatus <> 'P'
    UNION ALL
    SELECT
        e.event_id AS session_id,
        e.user_id,
        e.ts - to_days(8234) AS session_start_ts,
        e.ts - to_days(8234) + to_minutes(CAST(1 + e.event_id % 40 AS INTEGER)) AS session_end_ts,
        CASE e.event_type WHEN 'click' THEN 'push' WHEN 'view' THEN 'organic' WHEN 'purchase' THEN 'paid'
             WHEN 'signup' THEN 'email' WHEN 'error' THEN 'direct' END AS session_source,
        CAST(e.event_type = 'click' AS INTEGER) AS is_push_opened,
        0 AS did_order
    FROM events e
),
fact_app_sessions AS (
    SELECT s.session_id, s.user_id, s.session_start_ts, s.session_end_ts, s.session_source,
           u.city, u.device_os, s.is_push_opened, s.did_order
    FROM sessions_raw s LEFT JOIN dim_users u ON s.user_id = u.user_id
),
fact_ab_test_assignments AS (
    SELECT
        c.c_custkey + 1 AS assignment_id,
        c.c_custkey AS user_id,
        'free_delivery_banner_v1' AS test_id,
        CASE WHEN c.c_custkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
        TIMESTAMP '2001-05-01 00:00:00'
            + to_days(CAST((c.c_custkey - c.c_custkey % 2) % 90 AS INTEGER))
            + to_minutes(CAST(c.c_custkey % 1440 AS INTEGER)) AS assigned_at,
        CASE c.c_custkey % 3 WHEN 0 THEN 'home_feed' WHEN 1 THEN 'push' ELSE 'search' END AS exposure_channel
    FROM customer c
)
"""


def with_canonical(body: str, extra_ctes: str = "") -> str:
    """``WITH <canonical ctes>[, <extra ctes>] <body>``."""
    ctes = CANONICAL_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}\n"

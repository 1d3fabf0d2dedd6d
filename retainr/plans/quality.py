"""Data-quality operators (R1-R4, R6): the declared constraints of the star schema and the
invariants the source data is built on, as distributed checks.

Scale notes
* Keys are counted with partial aggregation, all keys of a table in one scan, so the
  duplicate and orphan tests join one row per key, never the raw fact rows; a key holding a
  large share of the rows is collapsed before the shuffle.
* NOT NULL and length checks are one aggregate pass per table.
* Item reconciliation joins per-order item totals (one row per order) to orders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

from retainr.operators.joins import date_range_join
from retainr.sources.schemas import (FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS,
                                     VARCHAR_LENGTHS)

AMOUNT_TOLERANCE = "0.01"

_RESULT_COLS = ["table_name", "rule", "column_name", "violations"]


def _rows(table: str, checks: list[tuple[str, str, str]], agg_source: DataFrame) -> DataFrame:
    """One aggregate pass over ``agg_source`` for all (rule, column, SQL count expression)
    checks, unpivoted with ``stack`` into one result row per check (expressions as SQL text:
    two JVM calls instead of several per check)."""
    one = agg_source.agg(*[F.expr(f"{expr} AS c{i}") for i, (_, _, expr) in enumerate(checks)])
    triples = ", ".join(f"'{rule}', '{column}', CAST(c{i} AS BIGINT)"
                        for i, (rule, column, _) in enumerate(checks))
    return one.selectExpr(f"'{table}' AS table_name",
                          f"stack({len(checks)}, {triples}) AS (rule, column_name, violations)")


def _key_text(columns: list[str]):
    """A key as text; the key of one column is NULL with it."""
    if len(columns) == 1:
        return col(columns[0]).cast("string")
    return F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in columns])


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per rule (not_null, max_length, primary_key, unique, foreign_key) for
    every table present in ``tables``; rows with 0 violations are kept (a full report).

    Each table is scanned once for all NOT NULL and length rules and once for all its keys: a row
    gives one (key number, value) pair for each primary, unique and foreign key, and one ``groupBy`` counts the
    pairs of all tables, combined before the shuffle.  Surplus counts are duplicates; counts of a foreign key without a
    counterpart under its parent's key number are orphans."""
    parts, report, numbers = [], [], {}

    def number(table: str, columns: list[str]) -> int:
        return numbers.setdefault((table, tuple(columns)), len(numbers))

    for name, schema in SCHEMAS.items():
        if name not in tables:
            continue
        checks = [("not_null", f.name, f"count_if(`{f.name}` IS NULL)")
                  for f in schema.fields if not f.nullable]
        checks += [("max_length", c, f"count_if(length(`{c}`) > {n})")
                   for c, n in VARCHAR_LENGTHS.get(name, {}).items()]
        parts.append(_rows(name, checks, tables[name]))
        for rule, keys in (("primary_key", [PRIMARY_KEYS[name]]), ("unique", UNIQUE_KEYS.get(name, []))):
            report += [(name, rule, ",".join(k), number(name, k)) for k in keys]
    parents = {}
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        if child in tables and parent in tables:
            parents[number(child, [ccol])] = number(parent, [pcol])
            report.append((child, "foreign_key", ccol, number(child, [ccol])))
    pairs = []
    for name in dict.fromkeys(t for t, _ in numbers):
        of_table = [F.struct(F.lit(i).alias("i"), _key_text(list(k)).alias("k"))
                    for (t, k), i in numbers.items() if t == name]
        pairs.append(tables[name].select(F.explode(F.array(*of_table)).alias("p")).select("p.i", "p.k"))
    counts = reduce(DataFrame.unionByName, pairs).groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("i").agg(F.sum(col("n") - 1).alias("v")).withColumn("foreign", F.lit(False))
    if parents:
        parent = F.element_at(F.create_map(*[F.lit(x) for pair in parents.items() for x in pair]), col("i"))
        child = counts.where(col("i").isin(*parents) & col("k").isNotNull()).withColumn("i_parent", parent)
        keys = counts.select(col("i").alias("i_parent"), "k")
        orphans = child.join(keys, ["i_parent", "k"], "left_anti").groupBy("i").agg(F.sum("n").alias("v"))
        found = found.unionByName(orphans.withColumn("foreign", F.lit(True)))
    rules = tables[next(iter(tables))].sparkSession.createDataFrame(
        [(*r, r[1] == "foreign_key") for r in report],
        "table_name string, rule string, column_name string, i int, foreign boolean")
    keyed = rules.join(found, ["i", "foreign"], "left").select(
        "table_name", "rule", "column_name", F.coalesce("v", F.lit(0)).cast("long").alias("violations"))
    return reduce(DataFrame.unionByName, [*parts, keyed]).select(*_RESULT_COLS)


def active_campaigns(orders: DataFrame, campaigns: DataFrame) -> DataFrame:
    """R2: each order with every campaign whose [start_date, end_date] holds its date (orders
    outside any campaign kept with NULLs); the promo qualifies when the basket reaches the
    campaign minimum, potential discount = basket x pct / 100."""
    o = orders.select("order_id", F.to_date("order_ts").alias("order_date"), "basket_value_rub")
    c = campaigns.select("campaign_id", "start_date", "end_date", "discount_pct", "min_basket_rub")
    j = date_range_join(o, "order_date", c, "start_date", "end_date", how="left")
    qualifies = col("basket_value_rub") >= col("min_basket_rub")
    return j.select(
        "order_id", "order_date", "campaign_id",
        F.coalesce(qualifies, F.lit(False)).cast("int").alias("qualifies"),
        F.when(qualifies, F.round(col("basket_value_rub") * col("discount_pct") / 100, 2))
        .otherwise(F.lit(0)).cast("double").alias("potential_discount_rub"),
    )


def reconcile_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per order the item total sum(quantity x unit price) against the basket.

    Flags: ``orphan_items`` (items without an order), ``items_on_cancelled``,
    ``missing_items`` (delivered without items), ``amount_mismatch`` (|total - basket| > 0.01
    for delivered orders), ``cogs_above_price_lines``.  Only orders with an issue are returned.
    """
    per_order = items.groupBy("order_id").agg(
        F.sum(col("quantity") * col("unit_price_rub")).alias("items_total"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(col("cogs_rub") > col("unit_price_rub")).alias("cogs_above_price_lines"),
    )
    o = orders.select("order_id", "order_status", "basket_value_rub")
    j = o.join(per_order, "order_id", "full_outer")
    has_items = F.coalesce(col("n_items"), F.lit(0)) > 0
    delivered = col("order_status") == "delivered"
    flags = {
        "orphan_items": col("order_status").isNull(),
        "items_on_cancelled": (col("order_status") == "cancelled") & has_items,
        "missing_items": delivered & ~has_items,
        "amount_mismatch": delivered & has_items
        & (F.abs(col("items_total") - col("basket_value_rub")) > F.lit(AMOUNT_TOLERANCE).cast("decimal(4,2)")),
    }
    cogs = F.coalesce(col("cogs_above_price_lines"), F.lit(0))
    out = j.select(
        "order_id", "order_status",
        col("basket_value_rub").cast("double").alias("basket_value_rub"),
        col("items_total").cast("double").alias("items_total_rub"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        cogs.cast("long").alias("cogs_above_price_lines"),
        *[F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in flags.items()],
    )
    any_issue = reduce(lambda a, b: a | b, [col(k) == 1 for k in flags]) | (col("cogs_above_price_lines") > 0)
    return out.where(any_issue)


def linear_margin(share: float, cost_per_km: float, low: float, high: float):
    """A margin rule: clip(share x basket + fee - discount - cost x km, low, high), in decimal arithmetic,
    rounded to cents."""
    raw = (F.lit(share).cast("decimal(3,2)") * col("basket_value_rub")
           + col("delivery_fee_rub") - col("discount_rub") - F.lit(cost_per_km) * col("distance_km"))
    return F.round(F.least(F.greatest(raw, F.lit(low)), F.lit(high)), 2)


def audit_margin(orders: DataFrame, expected, cancelled_range: tuple[float, float]) -> DataFrame:
    """Orders breaking the caller's margin rule (delivered: off the column ``expected`` by more than
    0.01; cancelled: margin outside ``cancelled_range``)."""
    delivered = col("order_status") == "delivered"
    bad_delivered = delivered & (F.abs(col("gross_margin_rub") - expected) > F.lit(AMOUNT_TOLERANCE).cast("decimal(4,2)"))
    bad_cancelled = (~delivered) & ~col("gross_margin_rub").between(*cancelled_range)
    return (
        orders.where(bad_delivered | bad_cancelled)
        .select("order_id", "order_status",
                col("gross_margin_rub").cast("double").alias("gross_margin_rub"),
                F.when(delivered, expected).cast("double").alias("expected_margin_rub"),
                F.when(delivered, "delivered_formula").otherwise("cancelled_range").alias("rule"))
    )


def link_sessions_orders(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Ordering sessions (did_order = 1) matched to the order of the same user placed at the
    session end.  Equi join on (user_id, timestamp): the composite key spreads a busy user."""
    s = sessions.where(col("did_order") == 1).select("session_id", "user_id",
                                                       col("session_end_ts").alias("order_ts"))
    o = orders.select("order_id", "user_id", "order_ts", "order_status")
    return s.join(o, ["user_id", "order_ts"]).select("session_id", "order_id", "user_id",
                                                     "order_ts", "order_status")

"""Physical layouts that stand in for the relational indexes.

``write_layout``: partition directories by month of the main timestamp (partition pruning for time ranges), rows sorted by
(user, time) inside each file.  It serves the (user, time) indexes.

``write_clustered``: rows in Z-order of several columns, so that a file spans a small range of each of them and min/max
statistics let the reader skip files on any of them.  It serves the (time, status), restaurant and campaign
indexes of the orders, (start, source) of the sessions, registration and (city, channel) of the users.

``write_bucketed``: tables bucketed by user, so that aggregates by user and joins on user need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col
from retainr.operators.ranking import RANGES, with_range

# Layout per table: (timestamp column for month partitions, sort columns).
LAYOUTS = {
    "fact_orders": ("order_ts", ["user_id", "order_ts"]),
    "fact_app_sessions": ("session_start_ts", ["user_id", "session_start_ts"]),
    "fact_ab_test_assignments": ("assigned_at", ["test_id", "variant", "user_id"]),
    "fact_order_items": (None, ["order_id"]),
    "dim_users": (None, ["user_id"]),
}

# Columns that queries cut by, beside user and order.
ACCESS_COLUMNS = {
    "fact_orders": ["order_ts", "order_status", "restaurant_id", "campaign_id"],
    "fact_app_sessions": ["session_start_ts", "session_source"],
    "fact_ab_test_assignments": ["assigned_at", "test_id", "variant"],
    "dim_users": ["registration_ts", "city", "acquisition_channel"],
}

# Facts and dimension that are joined on the user.
USER_TABLES = {
    "dim_users": ["user_id"],
    "fact_orders": ["user_id", "order_ts"],
    "fact_app_sessions": ["user_id", "session_start_ts"],
    "fact_ab_test_assignments": ["user_id", "assigned_at"],
}

CODE_BITS = RANGES.bit_length() - 1


def write_layout(df: DataFrame, path: str, table: str, mode: str = "overwrite",
                 tasks: int | None = None) -> None:
    """Write ``df`` partitioned by month and clustered by the table's sort columns.

    Rows are dealt by range of (month, sort columns) over ``tasks`` writers (the shuffle partitions of the
    session when None), so a large month is several files and several tasks."""
    ts_col, sort_cols = LAYOUTS.get(table, (None, []))
    out = df
    writer_parts = []
    if ts_col:
        out = out.withColumn("ym", F.date_format(ts_col, "yyyy-MM"))
        writer_parts = ["ym"]
        keys = ["ym", *sort_cols]
        out = out.repartitionByRange(tasks, *keys) if tasks else out.repartitionByRange(*keys)
    if sort_cols:
        out = out.sortWithinPartitions(*sort_cols)
    w = out.write.mode(mode)
    if writer_parts:
        w = w.partitionBy(*writer_parts)
    w.parquet(path)


def _interleaved(codes: list[Column], bits: int) -> Column:
    """Bits of several codes in turn, the highest first."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for j, c in enumerate(codes):
            bit = F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(codes) + len(codes) - 1 - j))
    return out


def z_order(df: DataFrame, columns: list[str], out: str = "z") -> DataFrame:
    """Add the Z-value of some columns: bits of their ranks in turn.

    A column's rank is the number of its range of distinct values (``operators.ranking``: ends from a sample, whatever the type and
    distribution), cut to as many bits as fit, the upper ones; null comes first.  Ranges hold equally many values and not rows, so that the
    values beside a frequent one (orders without a campaign) are told apart as well."""
    bits = min(CODE_BITS, 63 // len(columns))
    ranked = df.withColumn("__o", F.lit(0))
    for j, c in enumerate(columns):
        values = df.select(F.lit(0).alias("__o"), F.struct(col(c)).alias("__v")).distinct()
        ranked = with_range(ranked.withColumn("__v", F.struct(col(c))), "__o", "__v", f"__z{j}", values).drop("__v")
    codes = [F.shiftright(col(f"__z{j}"), CODE_BITS - bits) for j in range(len(columns))]
    return ranked.withColumn(out, _interleaved(codes, bits)).drop("__o", *[f"__z{j}" for j in range(len(columns))])


def write_clustered(df: DataFrame, path: str, table: str, files: int | None = None, columns: list[str] | None = None,
                    mode: str = "overwrite") -> None:
    """Write ``df`` in Z-order of ``columns`` (default: the table's ``ACCESS_COLUMNS``), as about ``files`` files (the shuffle partitions of
    the session when None)."""
    z = z_order(df, columns or ACCESS_COLUMNS[table], "__z")
    # equal Z-values (a frequent status on one day) are cut by a hash of the row
    keys = ["__z", F.xxhash64(*df.columns)]
    z = z.repartitionByRange(files, *keys) if files else z.repartitionByRange(*keys)
    z.sortWithinPartitions("__z").drop("__z").write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, name: str | None = None) -> DataFrame:
    """Write a user table as a catalog table in ``buckets`` buckets of the user, sorted by user and time, and return it.

    Tables written with the same number of buckets are grouped and joined by user without a shuffle.  A bucket is one task's
    worth, so give as many as the largest table needs; a single user's rows cannot be cut."""
    name = name or f"{table}_by_user"
    df.write.mode("overwrite").bucketBy(buckets, "user_id").sortBy(*USER_TABLES[table]).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)

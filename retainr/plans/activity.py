"""Mergeable daily activity: exact distinct users of any period from one bitmap row a day and block of users.

``daily_users`` reduces sessions to (dt, block, users): bit i of ``users`` is user ``block`` x 32,768 + i.  Bitmaps of
days merge by OR, which is exact, associative and idempotent: weeks and months come from stored days without the sessions,
and a day that arrives late, twice or in parts does no harm.  A day's scan is the only one ever made of its sessions.

Size: 4 KB for each block of 32,768 ids and day, a bit per user and day where ids are dense, before Parquet's compression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retainr.functions.columns import col
from retainr.functions.dates import week_start, year_month
from retainr.functions.numeric import round_ratio

SCHEMA = "dt date, block long, users binary"


def daily_users(sessions: DataFrame) -> DataFrame:
    """(dt, block, users) of the sessions' users by start date; sessions without a user or a start count nowhere."""
    return (
        sessions.where(col("user_id").isNotNull() & col("session_start_ts").isNotNull())
        .groupBy(F.to_date("session_start_ts").alias("dt"), F.bitmap_bucket_number("user_id").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users"))
    )


def merge_days(state: DataFrame) -> DataFrame:
    """One row for each (dt, block): rows of a day that was stored in parts or twice are merged."""
    return state.groupBy("dt", "block").agg(F.bitmap_or_agg("users").alias("users"))


def append_days(sessions: DataFrame, path: str) -> None:
    """Store the state of some sessions (a day, a late batch): rows are added, readers merge them."""
    daily_users(sessions).write.mode("append").partitionBy("dt").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def distinct_users(state: DataFrame, period: Column, name: str, out: str) -> DataFrame:
    """(``name``, ``out``): exact distinct users of each period of days; ``period`` is an expression of ``dt``."""
    merged = state.groupBy(period.alias(name), "block").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(name).agg(F.sum(F.bitmap_count("users")).alias(out))


def wau_mau_stickiness(state: DataFrame, week_mode: str = "literal") -> DataFrame:
    """Q11 from daily state; see ``kpis.wau_mau_stickiness``."""
    wau = distinct_users(state, week_start(col("dt"), week_mode), "week_start", "wau").withColumn("ym", year_month("week_start"))
    mau = distinct_users(state, year_month("dt"), "ym", "mau")
    return wau.join(mau, "ym").select(
        "week_start", "wau", "ym", "mau", round_ratio(col("wau"), col("mau"), 4).alias("stickiness_wau_mau")).orderBy("week_start")

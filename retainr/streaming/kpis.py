"""Daily KPIs of running streams (Q10): event-time days with a watermark and a state store.

A day is emitted once, when the watermark has passed its end, so its figures are final; ``late`` says how far behind the newest event a
row may come and still count.  Rows that are later than that are dropped, and so are repeated ids within that time.  Distinct
users stay exact: a day's state holds a bitmap for each block of 32,768 user ids, of 4 KB, and not the users themselves.
A query that is started again with its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retainr.functions.columns import col
from retainr.functions.numeric import round_money, round_ratio
from retainr.plans.common import delivered, revenue
from retainr.sources.schemas import SCHEMAS

LATE = "2 days"


def daily_kpis(sessions: DataFrame, orders: DataFrame, late: str = LATE) -> DataFrame:
    """The columns of ``kpis.daily_kpis`` from two streams (or tables) with the canonical columns.

    Days without sessions are left out, as there.  Rows without a time belong to no day."""
    money = "decimal(14,2)"
    none = F.lit(None).cast(money)
    s = sessions.select(
        F.lit("session").alias("kind"), col("session_id").alias("id"), col("session_start_ts").alias("ts"), "user_id",
        none.alias("revenue"), none.alias("margin"), none.alias("basket"))
    o = delivered(orders).select(
        F.lit("order").alias("kind"), col("order_id").alias("id"), col("order_ts").alias("ts"), "user_id",
        revenue().cast(money).alias("revenue"), col("gross_margin_rub").cast(money).alias("margin"),
        col("basket_value_rub").cast(money).alias("basket"))
    events = s.unionByName(o).withColumn("ts", col("ts").cast("timestamp")).where(col("ts").isNotNull())
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["kind", "id"])
    is_order, at = col("kind") == "order", F.bitmap_bit_position("user_id")
    blocks = once.groupBy(F.window("ts", "1 day").alias("day"), F.bitmap_bucket_number("user_id").alias("block")).agg(
        F.count_if(~is_order).alias("sessions_n"), F.count_if(is_order).alias("orders_n"),
        F.bitmap_construct_agg(F.when(~is_order, at)).alias("visitors"), F.bitmap_construct_agg(F.when(is_order, at)).alias("buyers"),
        F.sum("revenue").alias("gmv"), F.sum("margin").alias("margin"), F.sum("basket").alias("basket"))
    days = blocks.groupBy("day").agg(
        F.sum(F.bitmap_count("visitors")).alias("dau"), F.sum("sessions_n").alias("sessions_n"),
        F.sum("orders_n").alias("delivered_orders_n"), F.sum(F.bitmap_count("buyers")).alias("buyers_n"),
        F.sum("gmv").alias("gmv"), F.sum("margin").alias("margin"), F.sum("basket").alias("basket"))
    cents = (col("basket") * 100).cast("decimal(28,0)")

    def amount(c: str):
        return F.coalesce(round_money(col(c)), F.lit(0.0))

    return days.where("sessions_n > 0").select(
        F.to_date("day.start").alias("dt"), "dau", "sessions_n", "delivered_orders_n", "buyers_n",
        round_ratio(col("buyers_n"), col("dau"), 4).alias("buyer_conversion_from_dau"),
        F.coalesce(round_ratio(cents, col("delivered_orders_n") * 100, 2), F.lit(0.0)).alias("aov_rub"),
        amount("gmv").alias("gmv_rub"), amount("margin").alias("gross_margin_rub"))


def start_daily_kpis(spark: SparkSession, sessions_dir: str, orders_dir: str, target: str, checkpoint: str,
                     late: str = LATE, available_now: bool = True) -> StreamingQuery:
    """Read Parquet files that arrive in two folders and append the finished days to the Parquet table ``target``."""
    def stream(table: str, path: str) -> DataFrame:
        return spark.readStream.schema(SCHEMAS[table]).parquet(path)

    writer = daily_kpis(stream("fact_app_sessions", sessions_dir), stream("fact_orders", orders_dir), late).writeStream.format(
        "parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()

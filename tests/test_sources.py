"""Typed CSV / Parquet / JDBC sources and sinks, layout and streaming ingestion."""

import os

import pytest
from pyspark.sql import functions as F

from retainr.checks.compare import compare
from retainr.plans import features
from retainr.sources import jdbc, layout, tables
from retainr.sources.mapping import canonical_tables
from retainr.streaming.ingest import ingest_csv_stream
from tests.conftest import SF_ORACLE, SF_SMALL

ORDER_HEADER = ("order_id,user_id,restaurant_id,courier_id,campaign_id,order_ts,order_status,"
                "delivery_minutes,basket_value_rub,delivery_fee_rub,discount_rub,payment_method,"
                "distance_km,is_express,gross_margin_rub")


def _write(path, lines, newline="\n"):
    with open(path, "w", newline="") as fh:
        fh.write(newline.join(lines) + newline)


def test_csv_round_trip(spark, scratch):
    t = canonical_tables(spark, SF_SMALL)
    subset = {n: t[n] for n in ("fact_orders", "dim_users")}
    counts = tables.save_tables(subset, scratch, fmt="csv")
    assert counts == {n: df.count() for n, df in subset.items()}
    back = tables.load_tables(spark, scratch, fmt="csv", names=list(subset))
    for n, df in subset.items():
        assert back[n].schema == tables.SCHEMAS[n] or back[n].dtypes == df.dtypes
        assert df.exceptAll(back[n]).count() == 0 and back[n].exceptAll(df).count() == 0


def test_csv_edge_cases(spark, scratch):
    path = os.path.join(scratch, "orders.csv")
    _write(path, [ORDER_HEADER,
                  '1,7,1,1,,2025-01-01 10:00:00.123456789,delivered,30,100.50,49.00,0.00,"card, visa",1.20,0,12.30',
                  '2,7,1,1,3,2025-01-02 11:00:00,cancelled,20,80.00,49.00,5.00,sbp,0.50,1,-25.00'],
           newline="\r\n")
    df = tables.load_table(spark, "fact_orders", path)
    rows = {r["order_id"]: r for r in df.collect()}
    assert rows[1]["campaign_id"] is None and rows[2]["campaign_id"] == 3
    assert rows[1]["payment_method"] == "card, visa"
    assert str(rows[1]["order_ts"]) == "2025-01-01 10:00:00"
    micro = tables.load_table(spark, "fact_orders", path, precision="micro").where("order_id = 1").first()
    assert micro["order_ts"].microsecond == 123456
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in tables.SCHEMAS["fact_orders"].fields]


def test_csv_malformed_row(spark, scratch):
    path = os.path.join(scratch, "bad.csv")
    _write(path, [ORDER_HEADER,
                  "1,7,1,1,,2025-01-01 10:00:00,delivered,30,100.50,49.00,0.00,card,1.20,0,12.30",
                  "2,not_a_number,1,1,,2025-01-01 10:00:00,delivered,30,1,1,1,card,1,0,1"])
    with pytest.raises(Exception):
        tables.load_table(spark, "fact_orders", path).collect()
    ok = tables.load_table(spark, "fact_orders", path, mode="PERMISSIVE", corrupt_column="_corrupt")
    bad = ok.where(F.col("_corrupt").isNotNull()).collect()
    assert len(bad) == 1 and "not_a_number" in bad[0]["_corrupt"]


def test_jdbc_round_trip_embedded_derby(spark):
    url = "jdbc:derby:memory:retainr_test;create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(1, 101).select(F.col("id").alias("user_id"), (F.col("id") % 5).alias("bucket"))
    jdbc.write_jdbc(df, url, "USERS_T", mode="overwrite", properties=props)
    back = jdbc.read_jdbc(spark, url, "USERS_T", properties=props, partition_column="user_id",
                          lower_bound=1, upper_bound=100, num_partitions=4)
    assert back.rdd.getNumPartitions() == 4
    assert back.count() == 100 and back.agg(F.sum("USER_ID")).first()[0] == 5050
    assert jdbc.mysql_url("db", "x") == "jdbc:mysql://db:3306/x"


def test_layout_partition_pruning(spark, scratch):
    orders = canonical_tables(spark, SF_SMALL)["fact_orders"]
    out = os.path.join(scratch, "orders_layout")
    layout.write_layout(orders, out, "fact_orders")
    back = spark.read.parquet(out)
    assert back.count() == orders.count()
    q = back.where((F.col("ym") == "1998-03") & (F.col("order_status") == "delivered"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered)]" in plan


def test_layout_splits_a_large_month(spark, scratch):
    orders = canonical_tables(spark, SF_SMALL)["fact_orders"].withColumn("order_ts", F.lit("1998-03-05 00:00:00").cast("timestamp_ntz"))
    out = os.path.join(scratch, "one_month")
    layout.write_layout(orders, out, "fact_orders", tasks=8)
    files = [f for f in os.listdir(os.path.join(out, "ym=1998-03")) if f.endswith(".parquet")]
    assert len(files) == 8
    assert spark.read.parquet(out).count() == orders.count()


def test_streaming_ingest_is_incremental(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    row = "{i},7,1,1,,2025-01-0{d} 10:00:00.5,delivered,30,100.00,49.00,0.00,card,1.00,0,10.00"
    _write(os.path.join(src, "a.csv"), [ORDER_HEADER, row.format(i=1, d=1), row.format(i=2, d=2)])
    target, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    ingest_csv_stream(spark, "fact_orders", src, target, ckpt).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    _write(os.path.join(src, "b.csv"), [ORDER_HEADER, row.format(i=3, d=3)])
    ingest_csv_stream(spark, "fact_orders", src, target, ckpt).awaitTermination()
    back = spark.read.parquet(target)
    assert sorted(r[0] for r in back.select("order_id").collect()) == [1, 2, 3]
    assert back.where("order_id = 3").first()["order_ts"].microsecond == 0


def test_adhoc_csv_with_timestamp_columns(spark, scratch):
    from pyspark.sql import types as T

    path = os.path.join(scratch, "adhoc.csv")
    _write(path, ["id,seen_at,label", "1,2025-02-03 04:05:06.789,a", "2,,b"])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("seen_at", T.StringType()),
                           T.StructField("label", T.StringType())])
    df = tables.load_table(spark, "adhoc", path, schema=schema, timestamp_cols=["seen_at"])
    assert dict(df.dtypes)["seen_at"] == "timestamp_ntz"
    rows = {r["id"]: r for r in df.collect()}
    assert str(rows[1]["seen_at"]) == "2025-02-03 04:05:06" and rows[2]["seen_at"] is None


def _files_with(path, column, value):
    """Files whose statistics of a column allow the value."""
    import pyarrow.parquet as pq

    hit = total = 0
    for f in sorted(os.listdir(path)):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(os.path.join(path, f)).metadata
            names = [meta.schema.column(i).name for i in range(meta.num_columns)]
            stats = [meta.row_group(g).column(names.index(column)).statistics for g in range(meta.num_row_groups)]
            total += 1
            hit += any(s.has_min_max and s.min <= value <= s.max for s in stats)
    return hit, total


def test_clustered_layout_skips_files_by_any_access_column(spark, scratch):
    orders = canonical_tables(spark, SF_ORACLE)["fact_orders"]
    z, plain = os.path.join(scratch, "z"), os.path.join(scratch, "plain")
    layout.write_clustered(orders, z, "fact_orders", files=32)
    orders.repartitionByRange(32, "user_id").sortWithinPartitions("user_id", "order_ts").write.parquet(plain)
    back = spark.read.parquet(z)
    assert back.columns == orders.columns and back.exceptAll(orders).count() == 0 and back.count() == orders.count()
    for column, value in (("campaign_id", 40), ("restaurant_id", 4), ("order_status", "cancelled")):
        few, files = _files_with(z, column, value)
        every, _ = _files_with(plain, column, value)
        assert files >= 24 and every == 32 and few <= 0.7 * files, (column, few, files)


def test_z_order_interleaves_and_handles_nulls(spark):
    df = spark.range(4096).select((F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"),
                                  F.when(F.col("id") % 3 > 0, F.col("id")).alias("c"))
    z = layout.z_order(df, ["a", "b"]).orderBy("z").toPandas()
    first = z.iloc[:1024]  # a quarter of the rows is a square of half the side
    assert first.a.max() < 34 and first.b.max() < 34
    c = layout.z_order(df, ["c"])
    nulls = c.where("c IS NULL").agg(F.min("z"), F.max("z")).first()
    assert nulls[0] == nulls[1] <= c.where("c IS NOT NULL").agg(F.min("z")).first()[0]
    assert layout.z_order(df.limit(0), ["a", "c"]).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, scratch):
    t = canonical_tables(spark, SF_SMALL)
    by_user = {n: layout.write_bucketed(t[n], n, os.path.join(scratch, n), 4) for n in layout.USER_TABLES}
    try:
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        args = [by_user[n] for n in ("dim_users", "fact_orders", "fact_app_sessions", "fact_ab_test_assignments")]
        got = features.user_features(*args, reference_date="2001-06-30 00:00:00", test_id="free_delivery_banner_v1")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        want = features.user_features(*[t[n] for n in ("dim_users", "fact_orders", "fact_app_sessions", "fact_ab_test_assignments")],
                                      reference_date="2001-06-30 00:00:00", test_id="free_delivery_banner_v1")
        ok, message = compare(got.toPandas(), want.toPandas())
        assert ok, message
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for n in layout.USER_TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {n}_by_user")

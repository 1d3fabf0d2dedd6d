"""Relational database source and sink over Spark JDBC.

Parallel reads split a numeric column into ``num_partitions`` ranges so that each executor
reads its own slice; writes go through ``batchsize``-sized inserts per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def mysql_url(host: str, database: str, port: int = 3306) -> str:
    return f"jdbc:mysql://{host}:{port}/{database}"


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              fetch_size: int = 10_000) -> DataFrame:
    props = dict(properties or {})
    props.setdefault("fetchsize", str(fetch_size))
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned reads need lower_bound, upper_bound and num_partitions")
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                               upperBound=upper_bound, numPartitions=num_partitions,
                               properties=props)
    return spark.read.jdbc(url, table, properties=props)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               properties: dict | None = None, batch_size: int = 10_000) -> None:
    props = dict(properties or {})
    props.setdefault("batchsize", str(batch_size))
    df.write.jdbc(url, table, mode=mode, properties=props)

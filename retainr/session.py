"""SparkSession construction and partition sizing."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on: AQE (runtime broadcast of small sides, partition coalescing,
# skew-join splitting), UTC session zone (all canonical timestamps are zone-free).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


MB = 1 << 20
GB = 1 << 30


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 executor_memory_gb: float = 16.0,
                 target_partition_bytes: int = 256 * MB) -> dict[str, str]:
    """Partition sizing for a cluster run.

    * Scan splits of ``target_partition_bytes`` (256 MB of Parquet, ~0.5-1 GB in memory).
    * Shuffle partitions: input / target (an upper bound of the largest shuffle; the fact-table
      shuffles here carry a few columns after partial aggregation, so far less), at least two
      waves of tasks over all cores.  AQE then coalesces small partitions to the same
      advisory size and splits skewed ones.
    * A task gets ``executor_memory / cores`` of heap; the advisory size is capped at a quarter
      of that so sorts and hash aggregates stay in memory instead of spilling.
    * Broadcast threshold stays small (64 MB): only dimensions that are small at the real scale
      are broadcast automatically; everything bigger is a shuffle join.
    """
    cores = max(1, executors * cores_per_executor)
    per_task = int(executor_memory_gb * GB / max(1, cores_per_executor))
    advisory = max(32 * MB, min(target_partition_bytes, per_task // 4))
    shuffle = max(2 * cores, -(-input_bytes // advisory))
    return {
        "spark.sql.files.maxPartitionBytes": str(advisory),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(advisory),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * advisory),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * MB),
        "spark.default.parallelism": str(2 * cores),
    }


def get_spark(master: str | None = None, app_name: str = "retainr",
              shuffle_partitions: int | None = None, extra_conf: dict | None = None,
              sizing: dict | None = None) -> SparkSession:
    """Return (or create) a session with the defaults above.

    On a cluster pass ``master=None`` so spark-submit decides, and ``sizing=cluster_conf(...)``
    for the data volume; tests pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(sizing or {})
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()

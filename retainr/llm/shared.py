"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local session without that setting (a
    test) gets a folder of its own; a cluster without it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="retainr-llm-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and not again when an
    executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/retainr-llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """Jobs run inside send their workers batches of about ``max_bytes`` (a larger row is a batch of its own): by default
    a batch is 10,000 rows, so what a task holds grows with the length of the rows.  The session's own limit goes first."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(max_bytes))
    try:
        yield
    finally:
        spark.conf.unset(key)


def importable(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the Python path of the workers, for sessions that
    were started elsewhere without ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in path:
        env["PYTHONPATH"] = os.pathsep.join([p for p in path if p] + [root])
    return spark

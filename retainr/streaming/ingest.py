"""Incremental loading of new table drops with Structured Streaming.

New CSV files of a canonical table that land in a folder are typed with the declared schema
(same rules as ``sources.tables.load_table``) and appended to a Parquet table.  The checkpoint
records which files were loaded, so a restarted or retried job loads each file exactly once;
``available_now`` processes what is there and stops (a scheduled batch load).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from retainr.sources.schemas import SCHEMAS
from retainr.sources.tables import _text_schema, _typed


def ingest_csv_stream(spark: SparkSession, name: str, source_dir: str, target_path: str,
                      checkpoint_path: str, precision: str = "second",
                      available_now: bool = True, max_files_per_trigger: int | None = None,
                      partition_by: list[str] | None = None) -> StreamingQuery:
    schema = SCHEMAS[name]
    reader = (spark.readStream.schema(_text_schema(schema)).option("header", True)
              .option("quote", '"').option("escape", '"').option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    typed = _typed(reader.csv(source_dir), schema, precision)
    writer = (typed.writeStream.format("parquet").option("path", target_path)
              .option("checkpointLocation", checkpoint_path).outputMode("append"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()

"""Typed loading and saving of the canonical tables.

CSV is read with the declared schema (never inferred).  Timestamp columns are read as text and
cast, so fractional seconds of any length load (trap T15); ``precision='second'`` truncates them
like the relational loader does.  Empty fields are NULL (S02).  ``mode='FAILFAST'`` rejects a
malformed row; ``'PERMISSIVE'`` keeps it with NULLs and, with ``corrupt_column``, the raw text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retainr.functions.columns import col
from pyspark.sql import types as T

from retainr.sources.schemas import SCHEMAS


def _text_schema(schema: T.StructType, extra: list[str] | None = None) -> T.StructType:
    """Declared schema with timestamp/date columns as strings (cast after the read)."""
    fields = []
    for f in schema.fields:
        dtype = T.StringType() if isinstance(f.dataType, (T.TimestampNTZType, T.DateType)) else f.dataType
        fields.append(T.StructField(f.name, dtype, True))
    for name in extra or []:
        fields.append(T.StructField(name, T.StringType(), True))
    return T.StructType(fields)


def _typed(df: DataFrame, schema: T.StructType, precision: str) -> DataFrame:
    cols = []
    for f in schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            c = F.trim(c).cast("timestamp_ntz")
            if precision == "second":
                c = F.date_trunc("second", c).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = F.trim(c).cast("date")
        cols.append(c.alias(f.name))
    rest = [col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *rest)


def load_table(spark: SparkSession, name: str, path: str, fmt: str = "csv",
               precision: str = "second", mode: str = "FAILFAST",
               corrupt_column: str | None = None, schema: T.StructType | None = None,
               timestamp_cols: list[str] | None = None) -> DataFrame:
    """Load one table with its declared schema.

    ``name`` selects the schema from the registry; pass ``schema`` for an ad-hoc file and
    ``timestamp_cols`` to type extra columns as timestamps (the ``parse_dates`` of S04).
    """
    schema = schema or SCHEMAS[name]
    if timestamp_cols:
        schema = T.StructType([
            T.StructField(f.name, T.TimestampNTZType(), f.nullable) if f.name in timestamp_cols else f
            for f in schema.fields])
    if fmt == "parquet":
        return spark.read.parquet(path).select(*[col(f.name).cast(f.dataType) for f in schema.fields])
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    reader = (spark.read.schema(_text_schema(schema, [corrupt_column] if corrupt_column else None))
              .option("header", True).option("quote", '"').option("escape", '"')
              .option("encoding", "UTF-8").option("mode", mode))
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return _typed(reader.csv(path), schema, precision)


def load_tables(spark: SparkSession, directory: str, fmt: str = "parquet",
                names: list[str] | None = None, **kwargs) -> dict[str, DataFrame]:
    """Every canonical table stored as ``<directory>/<name>[.csv|.parquet]``."""
    suffix = {"csv": ".csv", "parquet": ".parquet"}[fmt]
    return {n: load_table(spark, n, f"{directory}/{n}{suffix}", fmt=fmt, **kwargs)
            for n in (names or list(SCHEMAS))}


def save_tables(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet",
                mode: str = "overwrite") -> dict[str, int]:
    """Write each table to ``<directory>/<name>.<fmt>`` (header for CSV) and return the rows
    written per table, counted during the write with ``observe`` (S05, no second pass)."""
    counts = {}
    for name, df in tables.items():
        obs = Observation(f"rows_{name}")
        observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
        writer = observed.write.mode(mode)
        if fmt == "csv":
            writer.option("header", True).csv(f"{directory}/{name}.csv")
        elif fmt == "parquet":
            writer.parquet(f"{directory}/{name}.parquet")
        else:
            raise ValueError(f"unsupported format {fmt!r}")
        counts[name] = int(obs.get["rows"])
    return counts

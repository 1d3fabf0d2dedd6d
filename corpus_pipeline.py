"""Corpus pipeline: five operators in a row, each on all that the one before kept.

1. toxicity: documents scored as toxic go;
2. near_duplicates: one document of each group stays;
3. decontaminate: documents that hold a benchmark item go;
4. redact_pii: personal data is replaced by its kind, n_chars follows;
5. mix_sources: documents are taken, and repeated, so that the sources meet their target weights.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and reads it again as the next stage's docs.  All stages but the last return the columns of
``documents``; the last adds ``copy`` (0, 1, ...) and returns a row for each time a document is taken.

Near duplicates are rows, whatever their ids: of equal or near texts one row stays, the one with the smallest id (null ids last),
also where rows share an id or have none.  Null or empty texts, and texts without words, are kept by all
filters and have size 0 in the mix, which takes them as often as any document of their source; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainr.llm import decontam, mixing, neardup, pii, toxicity
from retainr.llm.shared import importable, stored

SIMILARITY = neardup.PERCENT  # shared 5-word shingles from which texts are near duplicates, in percent: as in operator 8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model, docs.columns, out="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids may repeat or be missing: rows are numbered once, in a stored table
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = stored(neardup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), percent=SIMILARITY).select(
        F.col("doc_id").alias("__row"), "component_id"), "components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    kept = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(
        F.min(order)["__row"].alias("__row")).select("__row")
    dropped = found.select("__row").join(kept, "__row", "left_anti")
    return rows.join(dropped, "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.redact(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.repeated(mixing.mix(docs))
    return mixed.select(*docs.columns, F.col("mix_copy").alias("copy"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


# toxicity is learned and decontamination uses an edit distance over words: no SQL;
# tests/llm/test_pipeline.py compares every stage with a plain Python version
ORACLE_SQL = None

"""Fitted one-hot encoding of category columns (F5, C21) as an ML Estimator and Transformer."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainr.functions.columns import col

MISSING = "unknown"
MAX_CATEGORIES = 1000


def category_values(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES,
                    missing: str = MISSING) -> dict[str, list[str]]:
    """Sorted distinct values of category columns, null as ``missing``.  All columns' (column, value) pairs are de-duplicated in one
    distributed aggregate.  The values become column names, so they must be few: at most one more than ``max_categories`` of
    a column are read, and a column that has more raises an error."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.coalesce(col(f"`{c}`").cast("string"), F.lit(missing)).alias("v")) for c in columns]))
    distinct = df.select(pairs.alias("p")).select("p.c", "p.v").distinct()
    # a plain limit over all columns bounds what the driver reads
    rows = distinct.limit(len(columns) * max_categories + 1).collect()
    out = {c: sorted(r["v"] for r in rows if r["c"] == c) for c in columns}
    too_many = [c for c in columns if len(out[c]) > max_categories]
    if too_many:
        raise ValueError(f"columns {too_many} have more than {max_categories} distinct values")
    return out


class CategoryEncoder(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the values of ``inputCols`` from the rows it is fitted on."""

    maxCategories = Param(Params._dummy(), "maxCategories", "most values of a column", TypeConverters.toInt)
    missing = Param(Params._dummy(), "missing", "value that stands for null", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, maxCategories=MAX_CATEGORIES, missing=MISSING):
        super().__init__()
        self._setDefault(maxCategories=MAX_CATEGORIES, missing=MISSING)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> CategoryEncoderModel:
        names, missing = self.getInputCols(), self.getOrDefault(self.missing)
        values = category_values(dataset, names, self.getOrDefault(self.maxCategories), missing)
        return CategoryEncoderModel(inputCols=names, categories=json.dumps(values), missing=missing)


class CategoryEncoderModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces each category column by one 0/1 column ``<column>_<value>`` for each learned value, none dropped.  A null counts
    as ``missing``; a value that was not learned is 0 in all of them.  A plain projection: no job, no join."""

    categories = Param(Params._dummy(), "categories", "learned values of each column as JSON", TypeConverters.toString)
    missing = Param(Params._dummy(), "missing", "value that stands for null", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, categories=None, missing=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def learned(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.categories))

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.learned().items() for v in values]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, missing = self.getInputCols(), self.getOrDefault(self.missing)
        flags = [
            (F.coalesce(col(f"`{c}`").cast("string"), F.lit(missing)) == v).cast("int").alias(f"{c}_{v}")
            for c, values in self.learned().items() for v in values]
        return dataset.select(*[col(f"`{c}`") for c in dataset.columns if c not in names], *flags)

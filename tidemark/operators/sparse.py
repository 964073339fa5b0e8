"""Scaling and one-hot encoding into one sparse vector, for columns with very many categories.

``FittedColumns`` makes a column per category, which is right for a few hundred; here a row stores its non-zero places
only and the plan has one expression per input column, however many categories there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.preprocess import FittedColumns, fit_columns


@dataclass(frozen=True)
class SparseColumns:
    """A fitted encoding: scaled numerics first, then one place per known category, sorted within each column.

    Unknown and NULL categories have no place (all zeros); a missing or non-finite number becomes the fit mean (0).
    ``model`` is a Spark ML pipeline that adds the vector ``features`` and can be saved with a model on top.
    """

    numeric: FittedColumns
    vocabulary: dict[str, list[str]]
    model: PipelineModel

    @property
    def names(self) -> list[str]:
        return self.numeric.names + [f"cat__{c}_{v}" for c, vs in self.vocabulary.items() for v in vs]

    @property
    def starts(self) -> dict[str, int]:
        """The first place of each categorical column."""
        at, out = len(self.numeric.moments), {}
        for c, values in self.vocabulary.items():
            out[c] = at
            at += len(values)
        return out

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` and the vector ``features``; every row stays."""
        return self.model.transform(df).select(*keep, "features")


def fit_sparse(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> SparseColumns:
    """Fit on the rows of ``df``: moments of the finite numbers and the categories of each column, taken as text.

    The categories are the model and go through the driver; a column of keys without bound wants target encoding or
    hashing instead.  A column that has only NULLs has no places.  Needs at least one number or category.
    """
    scaled = fit_columns(df, numeric)
    stages = [scaled.stage()] if scaled.moments else []
    parts, vocabulary = scaled.names, {c: [] for c in categorical}
    if categorical:
        index = [f"__index_{i}" for i in range(len(categorical))]
        indexer = StringIndexer(inputCols=list(categorical), outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep")
        indexed = indexer.fit(df)
        vocabulary = dict(zip(categorical, map(list, indexed.labelsArray)))
        held = [i for i, c in zip(index, categorical) if vocabulary[c]]
        stages.append(indexed)
        if held:
            # the place after the known categories stands for all others, and the encoder drops the last place
            vectors = [f"{i}_vector" for i in held]
            encoder = OneHotEncoder(inputCols=held, outputCols=vectors, dropLast=True)
            stages.append(encoder.fit(indexed.transform(df.limit(0))))
            parts = [*parts, *vectors]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return SparseColumns(scaled, vocabulary, PipelineModel(stages))


def nonzero(vector: str) -> Column:
    """The non-zero places of a vector column as array<struct<place int, value double>>, by place."""
    v = F.unwrap_udt(F.col(vector))
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.transform(v["values"], lambda _, i: i))
    pairs = F.arrays_zip(places.alias("place"), v["values"].alias("value"))
    return F.filter(pairs, lambda p: p["value"] != 0)


def vector_size(vector: str) -> Column:
    v = F.unwrap_udt(F.col(vector))
    return F.when(v["type"] == 0, v["size"]).otherwise(F.size(v["values"]))

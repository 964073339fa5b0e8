"""Scaling, one-hot and target encoding, fitted on one frame and applied to others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import long_form
from tidemark.operators.ordering import small_side

MAX_CATEGORIES = 10_000


def finite(c: Column) -> Column:
    """The value as a double; NULL for NaN and infinities, which count as missing."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


@dataclass(frozen=True)
class FittedColumns:
    """Moments and vocabularies of the fit rows.

    Output order: scaled numerics, then one 0/1 column per known category.
    Other input columns do not become features.  Unknown and NULL categories
    give zeros.
    """

    moments: dict[str, tuple[float, float]] = field(default_factory=dict)
    vocabulary: dict[str, list[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [f"num__{c}" for c in self.moments] + [f"cat__{c}_{v}" for c, vs in self.vocabulary.items() for v in vs]

    def columns(self) -> dict[str, Column]:
        made = {f"num__{c}": (finite(F.col(c)) - m) / s for c, (m, s) in self.moments.items()}
        for c, vs in self.vocabulary.items():
            for v in vs:
                made[f"cat__{c}_{v}"] = F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).cast("double")
        return made

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, "numeric" if n.startswith("num__") else "categorical") for i, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "position int, feature string, role string")

    def stage(self) -> SQLTransformer:
        """The same columns as a Spark ML stage, so that a saved model carries its fit.

        A missing or non-finite numeric value becomes the fit mean (0 after scaling).
        """
        cells = []
        for c, (m, s) in self.moments.items():
            value = f"cast(`{c}` as double)"
            finite_only = f"CASE WHEN NOT isnan({value}) AND abs({value}) < double('Infinity') THEN {value} END"
            cells.append(f"coalesce(({finite_only} - ({m!r}D)) / {s!r}D, 0D) AS `num__{c}`")
        for c, vs in self.vocabulary.items():
            for v in vs:
                text = v.replace("\\", "\\\\").replace("'", "\\'")
                cells.append(f"CASE WHEN `{c}` = '{text}' THEN 1D ELSE 0D END AS `cat__{c}_{v}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def fit_columns(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), max_categories: int = MAX_CATEGORIES
) -> FittedColumns:
    """Mean and population std of the finite values per numeric column (std 0 counts as 1), sorted vocabulary per
    categorical one."""
    moments: dict[str, tuple[float, float]] = {}
    if numeric:
        values = long_form(df, numeric).withColumn("value", finite(F.col("value")))
        rows = values.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
        found = {r["feature"]: (r["m"] or 0.0, r["s"] or 1.0) for r in rows.collect()}
        moments = {c: found.get(c, (0.0, 1.0)) for c in numeric}
    return FittedColumns(moments, vocabularies(df, categorical, max_categories))


def vocabularies(df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    if not columns:
        return {}
    seen = long_form(df, columns, "string").where("value IS NOT NULL").distinct()
    found = seen.limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise ValueError(f"more than {max_categories} categories in {list(columns)}; use target encoding")
    return {c: sorted(r["value"] for r in found if r["feature"] == c) for c in columns}


def target_encode(
    train: DataFrame, df: DataFrame, column: str, target: str, smoothing: float = 0.0, name: str | None = None
) -> DataFrame:
    """Mean target of the category over the training rows; unseen categories get the overall mean."""
    name = name or f"{column}_encoded"
    overall = train.agg(F.avg(target)).first()[0]
    means = train.groupBy(column).agg(F.avg(target).alias("__m"), F.count(target).alias("__n"))
    groups = means.count()
    shrunk = (F.col("__m") * F.col("__n") + F.lit(overall) * smoothing) / (F.col("__n") + smoothing)
    table = means.select(F.col(column).alias("__c"), shrunk.alias(name))
    joined = df.join(small_side(table, groups), F.col(column).eqNullSafe(F.col("__c")), "left").drop("__c")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(overall)))

"""Checking, completing and gating scoring requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import positions

# fixed values: request fields, category domain, stand-in price
REQUIRED = ("feature1", "feature2", "feature3", "category_feature")
NUMERIC = ("feature1", "feature2", "feature3")
CATEGORIES = ("category_a", "category_b", "category_c")
DUMMY_PRICE = 100.0


def validate_payloads(
    df: DataFrame,
    payload: str = "features",
    required: Sequence[str] = REQUIRED,
    numeric: Sequence[str] = NUMERIC,
    category: str = "category_feature",
    allowed: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """Adds ``errors`` (array of codes) and ``valid`` to rows with a map<string,string> payload."""
    field = F.col(payload)

    def missing(name: str) -> Column:
        return F.when(field[name].isNull(), F.lit(f"missing:{name}"))

    def not_numeric(name: str) -> Column:
        bad = field[name].isNotNull() & field[name].try_cast("double").isNull()
        return F.when(bad, F.lit(f"not_numeric:{name}"))

    value = field[category]
    bad_category = F.when(value.isNotNull() & ~value.isin(list(allowed)), F.concat(F.lit("category:"), value))
    checks = [*[missing(c) for c in required], bad_category, *[not_numeric(c) for c in numeric]]
    errors = F.array_compact(F.array(*checks))
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("valid").drop("errors", "valid")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("NOT valid").drop("valid")


def payload_columns(
    df: DataFrame, payload: str = "features", numeric: Sequence[str] = NUMERIC, category: str = "category_feature"
) -> DataFrame:
    """The payload map spread into typed columns."""
    field = F.col(payload)
    cells = [field[c].try_cast("double").alias(c) for c in numeric] + [field[category].alias(category)]
    return df.select(*[c for c in df.columns if c != payload], *cells)


def fill_defaults(df: DataFrame, now: Column, time: str = "timestamp", target: str = "price") -> DataFrame:
    """Scoring rows without a time get the job's time, without a price a dummy price."""
    have = set(df.columns)
    t = F.coalesce(F.col(time), now.cast("timestamp_ntz")) if time in have else now.cast("timestamp_ntz")
    p = F.coalesce(F.col(target), F.lit(DUMMY_PRICE)) if target in have else F.lit(DUMMY_PRICE)
    return df.withColumn(time, t).withColumn(target, p)


def request_id(df: DataFrame, name: str = "request_id") -> DataFrame:
    """Repeatable id of the full row."""
    return df.withColumn(name, F.xxhash64(F.to_json(F.struct(*df.columns))))


def gated_groups(
    df: DataFrame, order: Sequence[str], every: int, rows_per_range: int | None = None
) -> DataFrame:
    """Rows numbered from 1 (``seq``), in groups of ``every`` (``gate``); ``check_here`` marks each ``every``-th row."""
    placed = positions(df, order, name="__p", rows_per_range=rows_per_range)
    seq = F.col("__p") + 1
    return placed.select(
        *df.columns, seq.alias("seq"), F.floor(F.col("__p") / every).alias("gate"), (seq % every == 0).alias("check_here")
    )


def score_table(
    model: PipelineModel,
    df: DataFrame,
    key: Sequence[str],
    inputs: Sequence[str],
    version: str = "unknown",
    radius: float | None = None,
    confidence: float | None = None,
) -> DataFrame:
    """Prediction records: key, prediction, model_version, confidence and, with a conformal radius, the band.

    ``inputs`` are the raw columns the model needs; column order does not
    matter, a missing one is an error.
    """
    missing = sorted(set(inputs) - set(df.columns))
    if missing:
        raise ValueError(f"missing features: {missing}")
    return score_records(model.transform(df), key, version, radius, confidence)


def score_records(
    scored: DataFrame,
    key: Sequence[str],
    version: str = "unknown",
    radius: float | None = None,
    confidence: float | None = None,
) -> DataFrame:
    """The records of rows that already have their ``y_pred``."""
    level = confidence if radius is not None else None
    p = F.col("y_pred")
    band = [] if radius is None else [(p - radius).alias("low"), (p + radius).alias("high")]
    return scored.select(
        *key,
        p.alias("prediction"),
        F.lit(version).alias("model_version"),
        F.lit(level).cast("double").alias("confidence"),
        *band,
    )

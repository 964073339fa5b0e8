"""Split-conformal prediction bands and retraining rules."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import P, Y, scored
from tidemark.operators.quantiles import exact_quantiles


def conformal_radius(calibration: DataFrame, alpha: float = 0.1, rows_per_range: int | None = None) -> float:
    """The ceil((n+1)(1-alpha))-th smallest absolute residual; infinite if n is too small for alpha."""
    residuals = scored(calibration).select(F.abs(F.col(Y) - F.col(P)).alias("r"))
    n = residuals.count()
    rank = math.ceil((n + 1) * (1 - alpha))
    if n == 0 or rank > n:
        return float("inf")
    prob = (rank - 1) / (n - 1) if n > 1 else 0.0
    return exact_quantiles(residuals, "r", [prob], rows_per_range=rows_per_range).first()[0][0]


def conformal_band(calibration: DataFrame, df: DataFrame, alpha: float = 0.1, **limits) -> DataFrame:
    radius = F.lit(conformal_radius(calibration, alpha, **limits))
    return df.withColumn("radius", radius).withColumn("low", F.col(P) - radius).withColumn("high", F.col(P) + radius)


def coverage(banded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # by residual: the row that set the radius sits on the edge, where low and high round
    inside = F.abs(F.col(Y) - F.col(P)) <= F.col("radius")
    return banded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(inside.cast("double")).alias("coverage"),
        (2 * F.max("radius")).alias("width"),
    )


@dataclass(frozen=True)
class RetrainRules:
    # fixed values: retraining limits
    wape_increase: float = 0.05
    new_rows: int = 1000
    max_age_days: int = 30


def retrain_triggers(status: DataFrame, rules: RetrainRules = RetrainRules()) -> DataFrame:
    """Decision table from a one-row status.

    ``status`` has old_wape, new_wape, drifted (number of drifted features),
    new_rows and age_days.
    """
    worse = F.try_divide(F.col("new_wape") - F.col("old_wape"), F.col("old_wape"))

    def rule(name: str, value: Column, limit: float) -> Column:
        v = value.cast("double")
        return F.struct(
            F.lit(name).alias("trigger"), v.alias("value"), F.lit(float(limit)).alias("threshold"), (v > limit).alias("fired")
        )

    rows = [
        rule("wape_increase", worse, rules.wape_increase),
        rule("drift", F.col("drifted"), 0),
        rule("new_rows", F.col("new_rows"), rules.new_rows),
        rule("age_days", F.col("age_days"), rules.max_age_days),
    ]
    return status.select(F.inline(F.array(*rows)))

"""Walk-forward backtests and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.metrics import P, Y, period_metrics
from tidemark.operators.ordering import ROWS_PER_RANGE, over_order
from tidemark.operators.splits import walk_forward
from tidemark.session import materialize

SCORES = ("wape", "mae", "r2", "tail_mae")


def naive_forecast(
    df: DataFrame, order: Sequence[str], target: str, by: Sequence[str] = (), lag: int = 1, **limits
) -> DataFrame:
    """``y_true`` is the target, ``y_pred`` the target ``lag`` rows earlier; warm-up rows are dropped."""
    out = over_order(df, lambda w: {P: F.lag(target, lag).over(w)}, order=order, by=by, reach=lag, **limits)
    return out.withColumn(Y, F.col(target)).where(F.col(P).isNotNull())


def rolling_mean_forecast(
    df: DataFrame, order: Sequence[str], target: str, by: Sequence[str] = (), window: int = 7, **limits
) -> DataFrame:
    def columns(w: WindowSpec) -> dict[str, Column]:
        return {P: F.avg(target).over(w.rowsBetween(-window, -1))}

    out = over_order(df, columns, order=order, by=by, reach=window, **limits)
    return out.withColumn(Y, F.col(target)).where(F.col(P).isNotNull())


def backtest_forecast(
    forecast: DataFrame,
    order: Sequence[str],
    train: int = 2000,
    val: int = 500,
    step: int = 100,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Per-period scores of a forecast that needs no fitting; one job for all periods."""
    rows = forecast.select(*order, Y, P)
    if rows.count() > (rows_per_range or ROWS_PER_RANGE):
        rows = materialize(rows)
    members = walk_forward(rows, order, train, val, step, ["val"], rows_per_range)
    scores = period_metrics(members, ["period"], rows_per_range)
    return scores.select(
        "period",
        F.lit(train).cast("long").alias("train_size"),
        F.col("sample_count").alias("val_size"),
        *SCORES,
    )


def backtest_predictions(
    forecast: DataFrame, order: Sequence[str], train: int, val: int, step: int, mode: str = "all", **limits
) -> DataFrame:
    """Prediction rows (period, pos, ...).

    Overlapping windows predict a row several times; ``latest`` keeps the
    prediction of the last period that holds it.
    """
    members = walk_forward(forecast, order, train, val, step, ["val"], **limits)
    if mode == "all":
        return members
    latest = members.groupBy("pos").agg(F.max_by(F.struct(*members.columns), "period").alias("r"))
    return latest.select("r.*")


def backtest_summary(periods: DataFrame) -> DataFrame:
    made = [F.count(F.lit(1)).alias("total_periods")]
    for s in SCORES:
        made += [F.avg(s).alias(f"mean_{s}"), F.stddev_pop(s).alias(f"std_{s}")]
    made += [F.min("wape").alias("min_wape"), F.max("wape").alias("max_wape")]
    return periods.agg(*made)


def backtest_trend(periods: DataFrame, metrics: Sequence[str] = ("wape", "mae", "r2")) -> DataFrame:
    """Least-squares slope of each metric over the periods, with its reading."""
    wide = periods.agg(*[F.regr_slope(F.col(m), F.col("period").cast("double")).alias(m) for m in metrics])
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("slope")) for m in metrics]
    rising = F.when(F.col("metric") == "r2", "improving").otherwise("degrading")
    falling = F.when(F.col("metric") == "r2", "degrading").otherwise("improving")
    label = F.when(F.col("slope") > 0, rising).otherwise(falling)
    return wide.select(F.inline(F.array(*cells))).withColumn("trend", label)


def worst_periods(periods: DataFrame) -> DataFrame:
    """Worst period per metric, the first on ties."""
    def worst(metric: str, sign: int) -> Column:
        at = F.struct(F.lit(sign) * F.col(metric), F.col("period"))
        return F.struct(F.lit(metric).alias("metric"), F.min_by("period", at).alias("period"), F.min_by(metric, at).alias("value"))

    picks = [worst("wape", -1), worst("mae", -1), worst("r2", 1)]
    wide = periods.agg(*[c.alias(f"m{i}") for i, c in enumerate(picks)])
    return wide.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(picks))]))).where("period IS NOT NULL")


def score_band(periods: DataFrame, metric: str = "wape") -> DataFrame:
    """Each period's score with the mean and the mean +- one population std."""
    s = periods.agg(F.avg(metric), F.stddev_pop(metric)).first()
    mean, std = (F.lit(v).cast("double") for v in (s[0], s[1]))
    return periods.select(
        "period", metric, mean.alias("mean"), (mean - std).alias("low"), (mean + std).alias("high")
    )


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    return scores.agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )


__all__ = [
    "backtest_forecast", "backtest_predictions", "backtest_summary", "backtest_trend", "naive_forecast",
    "rolling_mean_forecast", "score_band", "score_summary", "worst_periods",
]
